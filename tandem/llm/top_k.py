"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are integers. The index is cut into blocks of vectors. In a block every dimension is a posting list,
ordered by component. For a query the postings' impacts (query component times vector component) are quantised into
levels, and the posting segments of all dimensions are added up level by level, the highest first. After a level every
posting that is still out adds no more than the level's lower end, which bounds every vector's score. The best by
bound are rescored exactly; once the bounds of half of the vectors are below the k-th best exact score, these are
proven out and the others are rescored. Levels after which the mean bound shows that no proof is near are added
together with the next one. Without a proof all levels are added and all vectors rescored.

The first index block gives every query a floor, its k-th best score there. In the other blocks a query starts with
it: a block whose greatest possible score is below the floor is skipped, and proofs come earlier.

Every index block meets every block of the stated queries: a join of blocks, whose number grows with the rows, while a
task holds one pair of them. A block is ordered once for each QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BLOCK, QUERIES, LEVELS = 8_192, 512, 16
#: Queries of a pack whose segments are looked up at once.
TOGETHER = 128


class Block:
    """The postings of one block: `order[d]` are the vectors by ascending component d, `sorted[d]` the components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by].astype(np.int64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors, self.order.T, axis=0).T.copy()
        self.floats, self.components = self.vectors.astype(float), self.sorted.astype(float)
        self.sums = np.pad(np.cumsum(self.components, axis=1), ((0, 0), (1, 0)))
        self.largest = int(np.abs(self.sorted[:, [0, -1]]).max())

    def _seen(self, queries: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """For every query, level and dimension how many postings have an impact above the level's lower end."""
        n = len(self.ids)
        out = np.zeros((*lows.shape, queries.shape[1]), np.int64)
        for d, weights in enumerate(queries.T):
            # low < weight * x is x > floor(low / weight) for a positive weight and x < ceil(low / weight) for a negative one
            up, down = weights > 0, weights < 0
            out[up, :, d] = n - np.searchsorted(self.sorted[d], lows[up] // weights[up, None], "right")
            out[down, :, d] = np.searchsorted(self.sorted[d], -(lows[down] // -weights[down, None]), "left")
        return out

    def top_of(self, queries: np.ndarray, owns: np.ndarray, floors: np.ndarray, k: int, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """For every query the ids and scores of the k best but its own, ties to smaller ids; whether a proof ended it early.

        Vectors that score less than the query's floor may be left out.
        """
        queries = queries.astype(np.int64)
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            ends = np.stack([self.sorted[:, 0] * some, self.sorted[:, -1] * some])
            caps, lowest = ends.max(0), ends.min((0, 2)) - 1
            highest = caps.max(1)
            step = np.maximum(1, -(-(highest - lowest) // (2 * levels)))
            turns = int(-(-(highest - lowest) // step).max())
            lows = np.maximum(highest[:, None] - step[:, None] * np.arange(1, turns + 1), lowest[:, None])
            # sums have to be exact as floating-point numbers; with larger components everything is rescored
            exact = self.largest * int(np.abs(some).max(initial=0)) * some.shape[1] ** 2 < 2**48
            seen = self._seen(some, lows) if exact else None
            for j, query in enumerate(some):
                own, floor = owns[i + j], floors[i + j]
                if caps[j].sum() < floor:
                    yield self.ids[:0], self.ids[:0], True
                else:
                    yield self._top(query, own, floor, k, caps[j], lows[j], seen[j] if exact else None)

    def _top(self, query, own, floor, k, caps, lows, seen) -> tuple[np.ndarray, np.ndarray, bool]:
        n, mine = len(self.ids), slice(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))
        keep, proof = np.arange(n), False
        weights, before = query.astype(float), np.zeros(len(query), np.int64)
        # the score so far and, in the digits above it, the number of postings added
        both, one = np.zeros(n), 2.0 ** (1 + (1 + int(self.largest * np.abs(query).sum())).bit_length())
        for low, now, rest, mean in zip(*self._levels(query, caps, lows, seen)) if seen is not None else ():
            if low > lows[-1] and now.sum() < (max(n, 2 * before.sum()) if mean >= floor else n):
                continue  # few vectors have postings yet, or the mean bound reaches the floor: no proof is near
            both += self._added(query, weights, before, now, one)
            before = now
            bound = both - np.rint(both / one) * (one + low) + rest
            bound[mine] = -np.inf
            some = min(n, max(4 * k, n // 64))
            best = np.argpartition(bound, n - some)[n - some :]
            best = best[bound[best] > -np.inf]
            if len(best) >= k:
                floor = max(floor, float(np.sort(self.floats[best] @ weights)[-k]))
            if floor > -np.inf:
                keep = np.flatnonzero(bound >= floor)
                if len(keep) <= max(8 * k, n // 2):
                    proof = True
                    break
        keep = keep[(keep < mine.start) | (keep >= mine.stop)]
        scores = (self.floats[keep] @ weights).astype(np.int64) if seen is not None else self.vectors[keep] @ query
        first = np.lexsort((self.ids[keep], -scores))[:k]
        return self.ids[keep][first], scores[first], proof

    def _levels(self, query, caps, lows, seen):
        """For every level its lower end, the postings above it in each dimension, what a vector without any of them may
        score, and the mean bound of all vectors once they are added.
        """
        n, dims = len(self.ids), np.arange(len(query))
        active = (query != 0) & (caps > lows[:, None])
        # what is still out adds the level's lower end at most, in dimensions without postings so far their greatest impact
        rest = active.sum(1) * lows.astype(float) + np.where(active | (query == 0), 0, caps).sum(1)
        up = query > 0
        impacts = np.where(up, self.sums[:, -1] - self.sums[dims, n - seen], self.sums[dims, seen]) @ query
        return lows.tolist(), seen, rest.tolist(), ((impacts - seen.sum(1) * lows) / n + rest).tolist()

    def _added(self, query, weights, before, now, one) -> np.ndarray:
        """For every vector the impacts of its postings in the segments from before to now, and `one` for each posting."""
        n, dims = len(self.ids), np.flatnonzero(now > before)
        if not len(dims):
            return np.zeros(n)
        up = query[dims] > 0
        spans = list(zip(dims.tolist(), np.where(up, n - now[dims], before[dims]).tolist(), np.where(up, n - before[dims], now[dims]).tolist(), strict=True))
        at = np.concatenate([self.order[d, a:b] for d, a, b in spans])
        impacts, end = np.empty(len(at)), 0
        for d, a, b in spans:
            np.multiply(self.components[d, a:b], weights[d], out=impacts[end : end + b - a])
            end += b - a
        impacts += one
        return np.bincount(at, impacts, n)

    def top(self, query: np.ndarray, own: int, k: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, bool]:
        return next(self.top_of(query[None], np.array([own]), np.array([-np.inf]), k, levels))


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, or null for vectors that are null, empty or not finite throughout."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: F.coalesce((F.abs(x(v)) < float("inf")) & ~F.isnan(x(v)), F.lit(False)))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda v: F.floor(x(v) * scale).cast("long")))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, vector, floor) in blocks: dims, `name` (the block's number within dims), blocks, ids, data and floors (binary)."""
    counts = rows.groupBy("dims").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(counts, "dims").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, data, floors = (x.tobytes() for x in (frame["vec_id"].to_numpy("<i8"), np.concatenate(frame["vector"].to_list()).astype("<i8"), frame["floor"].to_numpy("<f8")))
        return pd.DataFrame([(key[0], key[1], int(frame["blocks"].iloc[0]), ids, data, floors)], columns=["dims", name, "blocks", "ids", "data", "floors"])

    return dealt.groupBy("dims", name).applyInPandas(pack, f"dims int, {name} int, blocks int, ids binary, data binary, floors binary")


def _met(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score: the k best of every index block for every query of every block of queries."""
    sides = asked.select("dims", "q", "blocks", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), F.col("floors").alias("query_floors"))
    per_dims = sides.groupBy("dims").agg(F.max("blocks").alias("qs"))
    pairs = index.drop("blocks", "floors").join(per_dims, "dims").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("qs")
    pairs = pairs.repartition("dims", "block", "q").join(sides.drop("blocks"), ["dims", "q"])

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids, owns = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.query_ids, "<i8")
                block = Block(ids, np.frombuffer(r.data, "<i8").reshape(len(ids), r.dims))
                queries = np.frombuffer(r.query_data, "<i8").reshape(len(owns), r.dims)
                best = list(block.top_of(queries, owns, np.frombuffer(r.query_floors, "<f8"), k))
                found, scores = (np.concatenate([b[i] for b in best]) for i in (0, 1))
                yield pd.DataFrame({"query_id": np.repeat(owns, [len(b[0]) for b in best]), "vec_id": found, "score": scores})

    return pairs.mapInPandas(find, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for every row that the condition `queries` selects.

    Scores are inner products of floor(scale * component); fewer than k rows are returned where there are fewer. Rows
    with a null vec_id, and vectors that are null, empty or hold a null or a non-finite component, take no part.
    Vectors of different lengths are never compared. A vec_id that comes more than once counts once, with its greatest
    vector in the order of arrays. An empty table gives an empty result. Scores have to fit 64 bits.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "topk")
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", queries.alias("asks"), quantised(F.col("embedding"), scale).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull()).groupBy("vec_id").agg(F.max("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = scratch.keep(rows.withColumn("dims", F.size("vector")), "rows")
    rows = rows.withColumn("floor", F.lit(float("-inf")))
    index = scratch.keep(_packed(rows.drop("asks"), BLOCK, "block"), "index")
    asked = rows.where("asks").drop("asks")
    first = scratch.keep(_met(index.where("block = 0"), scratch.keep(_packed(asked, QUERIES, "q"), "asked"), k), "first")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
    asked = asked.join(floors.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    asked = asked.withColumn("floor", F.coalesce("least", "floor")).drop("least")
    found = first.unionByName(_met(index.where("block > 0"), scratch.keep(_packed(asked, QUERIES, "q"), "again"), k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
