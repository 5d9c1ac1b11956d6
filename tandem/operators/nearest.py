"""The most similar training item by Tanimoto similarity, on prints in bands of equal bit counts.

Prints with a and b bits are at most min(a, b) / max(a, b) alike. Training prints are kept in bands by their bit count, a band of
many prints in pieces. A query first meets the band of its own count, then the bands next to it, then all others, each time only bands
whose bound is above the best similarity so far; most bands are never met where queries have near neighbours. A piece of a band is
sent on once for every BLOCK queries that meet it, so no row is copied to blocks that it cannot serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.tables import written

#: Prints, and queries, that a task compares.
BLOCK = 2048
#: How far from its own bit count a query looks in each turn; the last turn looks everywhere.
REACHES = (0, 2, None)


def bit_count(words: Column) -> Column:
    return F.aggregate(F.coalesce(words, F.array().cast("array<long>")), F.lit(0), lambda s, w: s + F.bit_count(w))


def _matrix(words: pa.ChunkedArray) -> np.ndarray:
    """Row by word, shorter prints filled up with zeros."""
    rows = [np.array(x or [], np.int64) for x in words.to_pylist()]
    out = np.zeros((len(rows), max([1, *map(len, rows)])), np.uint64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x.view(np.uint64)
    return out


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a with all of b; 0 without common bits."""
    n = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))
    both = np.zeros((len(a), len(b)), np.int32)
    for w in range(n):
        both += np.bitwise_count(a[:, w, None] & b[None, :, w])
    whole = np.bitwise_count(a).sum(1, dtype=np.int32)[:, None] + np.bitwise_count(b).sum(1, dtype=np.int32) - both
    return both / np.maximum(1, whole)


def _meet(keys: tuple, queries: pa.Table, train: pa.Table) -> pa.Table:
    found = similarities(_matrix(queries["_w"]), _matrix(train["_w"])) if len(queries) and len(train) else np.zeros((len(queries), 0))
    places: dict = {}
    for k, t in enumerate(train["_t"].to_pylist()):
        places.setdefault(t, []).append(k)
    met = np.full(len(found), found.shape[1])
    for i, q in enumerate(queries["_q"].to_pylist()):
        own = places.get(q, []) if q is not None else []
        found[i, own] = -1.0
        met[i] -= len(own)
    best = found.max(1, initial=-1.0)
    return pa.table({"_r": queries["_r"], "_found": best, "_n": met.astype(np.int64)})


def _still_to_meet(reach: int | None, before: int | None):
    """Whether a query meets a band in this turn: its bound is above the best so far, and it lies within reach and beyond the turn before."""

    def test(band: Column) -> Column:
        apart = F.abs(F.col("_b") - band)
        bound = F.coalesce(F.try_divide(F.least("_b", band).cast("double"), F.greatest("_b", band).cast("double")), F.lit(0.0))
        ok = bound > F.col("_best")
        ok = ok if reach is None else ok & (apart <= reach)
        return ok if before is None else ok & (apart > before)

    return test


def nearest_tanimoto(queries: DataFrame, train: DataFrame, item: str, words: str, counted: bool = False, block: int | None = None, carried: list[str] | None = None) -> DataFrame:
    """item and `nearest`: the highest Tanimoto similarity with a training item of another id; 0 without common bits.

    One row for each row of queries. `nearest` is NULL where there is no other item in training; NULL prints have no bits; rows
    without an id have no own item. With `counted`, also `met`, the training items a query was compared with; columns of
    queries that are named in `carried` go along.
    """
    block = block or BLOCK
    rows = queries.select(F.monotonically_increasing_id().alias("_r"), F.col(item).alias("_q"), F.col(words).alias("_w"), bit_count(F.col(words)).alias("_b"), F.struct(F.lit(0).alias("_"), *(carried or [])).alias("_more"))
    rows = written(rows.withColumns({"_best": F.lit(-1.0), "_met": F.lit(0).cast("long")}), "queries")
    kept = written(train.select(F.col(item).alias("_t"), F.col(words).alias("_w"), bit_count(F.col(words)).alias("_band")), "prints")
    # one row for each different number of bits
    bands = sorted((r._band, r.n) for r in kept.groupBy("_band").agg(F.count("*").alias("n")).collect())
    pieces = F.create_map(*[F.lit(x) for b, n in bands for x in (b, -(-n // block))]) if bands else F.create_map(F.lit(-1), F.lit(1))
    kept = kept.withColumn("_piece", F.pmod(F.xxhash64("_t", "_w"), pieces[F.col("_band")]))
    all_bands = F.array(*[F.lit(b) for b, _ in bands]).cast("array<int>")
    before = None
    for reach in REACHES:
        asks = rows.select("_r", "_q", "_w", F.explode(F.filter(all_bands, _still_to_meet(reach, before))).alias("_band"))
        counts = {r._band: r.n for r in asks.groupBy("_band").agg(F.count("*").alias("n")).collect()}
        before = reach
        if not counts:
            continue
        groups = F.create_map(*[F.lit(x) for b, n in counts.items() for x in (b, -(-n // block))])
        # a query meets every piece of a band; queries of a band are dealt into groups, and a piece goes to each group once
        asks = asks.withColumn("_group", F.pmod(F.xxhash64("_r"), groups[F.col("_band")]))
        asks = asks.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), (pieces[F.col("_band")] - 1).cast("long"))))
        prints = kept.where(F.col("_band").isin(*counts)).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), (groups[F.col("_band")] - 1).cast("long"))))
        by = ["_band", "_piece", "_group"]
        found = asks.groupBy(*by).cogroup(prints.groupBy(*by)).applyInArrow(_meet, "_r long, _found double, _n long")
        found = found.groupBy("_r").agg(F.max("_found").alias("_found"), F.sum("_n").alias("_n"))
        rows = rows.join(found, "_r", "left").select(
            "_r", "_q", "_w", "_b", "_more", F.greatest("_best", F.coalesce("_found", F.lit(-1.0))).alias("_best"), (F.col("_met") + F.coalesce("_n", F.lit(0))).alias("_met")
        )
        rows = written(rows, "queries")
    out = [F.col("_q").alias(item), F.when(F.col("_best") >= 0, F.col("_best")).alias("nearest")]
    out += [F.col(f"_more.{c}") for c in carried or []] + ([F.col("_met").alias("met")] if counted else [])
    return rows.select(*out)


def support_features(queries: DataFrame, train: DataFrame, item: str, words: str, group: str) -> DataFrame:
    """item, `support` (log1p of how many training items share the group; those without one share nothing) and `ood` (1 - nearest)."""
    near = nearest_tanimoto(queries, train, item, words, carried=[group])
    sizes = train.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    return near.join(sizes, group, "left").select(item, F.log1p(F.coalesce("_n", F.lit(0)).cast("double")).alias("support"), (1 - F.col("nearest")).alias("ood"))


def skipped_share(counted: DataFrame, n_train: int) -> float:
    """Of all pairs of queries and training items, the share that `met` shows was never compared."""
    n, met = counted.agg(F.count("*"), F.coalesce(F.sum("met"), F.lit(0))).first()
    return 1 - met / max(1, n * n_train)

