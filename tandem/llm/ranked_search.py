"""Ranked lexical search by three phases of uniform thresholds over postings that are partitioned by term.

Every term of the queries has a list of postings (document, impact), ordered by impact and cut into segments of bounded
size, so that no task holds the list of a term that every document has. A query adds the lists of its terms, each
multiplied by the term's weight and its count in the query.

1. The heads of all lists give partial scores. The best documents seen are looked up in full, and the k-th best score
   is a lower bound b of the k-th best of all.
2. Every list of a query of m lists is cut at one threshold t <= b / m. A document that no list has above it scores
   less than m * t <= b and is out. What lies above goes to the documents' blocks, where a document's sum is a lower
   bound, and the sum plus t - 1 for each list that did not have it above t an upper bound. The k-th best lower bound of all
   blocks replaces b where it is greater, and documents whose upper bound is below b are out.
3. The rest are looked up exactly and ranked.

A smaller t leaves fewer documents for the third phase and reads more postings in the second; `share` is t * m / b.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small_batches

#: Digits, letters of ASCII and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Different terms of the queries that are searched at a time, all queries' terms summed. This bounds what is broadcast.
BATCH = 20_000
#: Postings in a segment of a list, on average.
SEGMENT = 16_384
#: Documents in a block, at most.
BLOCK_BITS = 12
#: Rows up to which looked-up pairs are broadcast; they are counted first.
BROADCAST_ROWS = 2_000_000


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times. Equal texts of one item_id count once, different ones are added; items without an id are left out."""
    texts = items.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), 0)
    return texts.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _counter(terms: list[str]):
    """A function of texts: the number of all terms, and which of the given ones occur how often."""
    number = {t.encode(): k for k, t in enumerate(terms)}
    pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # TERM over UTF-8
    kind = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    @F.arrow_udf("n long, terms array<int>, tfs array<int>")
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.cast(pa.binary()):
            found = pattern.findall((raw.as_py() or b"").lower())
            known = [(number[t], c) for t, c in Counter(found).items() if t in number]
            out.append({"n": len(found), "terms": [t for t, _ in known], "tfs": [c for _, c in known]})
        return pa.array(out, kind)

    return count


class Search:
    """One batch of queries: at most BATCH terms, or a single item's. `queries` has (item_id, term, times) of all of them."""

    def __init__(self, docs: DataFrame, queries: list, scratch: Scratch, name: str, k: int, head: int, probe: int, share: float):
        self.spark, self.scratch, self.name, self.k = docs.sparkSession, scratch, name, k
        self.head, self.probe, self.share = head, probe, share
        self.items = sorted({q.item_id for q in queries})
        self.terms = sorted({q.term for q in queries})
        self._index(docs)
        item, term = {x: i for i, x in enumerate(self.items)}, {x: i for i, x in enumerate(self.terms)}
        weight = {t: math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1))) for t, df in self.df.items()}
        #: item, term, factor: the lists of every query, without those that add nothing.
        rows = sorted((item[q.item_id], term[q.term], q.times * weight.get(term[q.term], 0)) for q in queries)
        self.lists = [r for r in rows if r[2] > 0]
        self.factors = F.broadcast(self.spark.createDataFrame(self.lists, "item int, term int, factor long"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep(df, f"{self.name}-{name}")

    def _index(self, docs: DataFrame) -> None:
        """Writes what each document has of the terms, and the lists: segments in order of impact."""
        counted = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _counter(self.terms)(F.col("text")).alias("c"))
        self.forward = self._keep(counted.select("doc_id", "row", "c.*"), "forward")
        sizes = self.forward.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
        self.n_docs, self.n_terms = sizes.n_docs, max(1, sizes.n_terms)
        self.df = {r.term: r.df for r in self.forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        segments = self.spark.createDataFrame([(t, -(-df // SEGMENT)) for t, df in self.df.items()], "term int, segments int")
        cut = self._postings(self.forward).join(F.broadcast(segments), "term")
        cut = cut.select("term", F.pmod(F.hash("row"), F.col("segments")).alias("segment"), "row", "impact")
        place = F.row_number().over(Window.partitionBy("term", "segment").orderBy(F.desc("impact"), "row"))
        self.index = self._keep(cut.withColumn("place", place), "index")

    def _postings(self, forward: DataFrame, *others: str) -> DataFrame:
        norm = F.expr(f"75L + (25L * n * {self.n_docs}L) div {self.n_terms}L")
        each = F.explode(F.arrays_zip("terms", "tfs")).alias("each")
        flat = forward.select(*others, "row", norm.alias("norm"), each).select(*others, "row", "norm", "each.terms", F.col("each.tfs").cast("long").alias("tf"))
        return flat.select(*others, "row", F.col("terms").alias("term"), F.expr("(1000000000L * tf) div (1000L * tf + 12L * norm)").alias("impact"))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """item, row, doc_id, score: exact scores of (item, row) pairs."""
        few = pairs.count() <= BROADCAST_ROWS
        met = self.forward.join(F.broadcast(pairs) if few else pairs.hint("merge"), "row")
        met = self._postings(met, "item", "doc_id").join(self.factors, ["item", "term"])
        # rows are told apart by their number; the id goes along
        return met.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("factor") * F.col("impact")).alias("score"))

    def _best(self, scored: DataFrame, n: int) -> DataFrame:
        by = Window.partitionBy("item").orderBy(F.desc("score"), "row")
        return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)

    def _bounds(self, scored: DataFrame) -> np.ndarray:
        """Each query's k-th best score, 0 with fewer than k."""
        out = np.zeros(len(self.items), np.int64)
        for r in self._best(scored, self.k).where(F.col("place") == self.k).select("item", "score").collect():
            out[r.item] = r.score
        return out

    def first_bounds(self) -> np.ndarray:
        """Phase 1."""
        by = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
        heads = self.index.where(F.col("place") <= self.head).withColumn("at", F.row_number().over(by)).where(F.col("at") <= self.head)
        partial = heads.join(self.factors, "term").groupBy("item", "row").agg(F.sum(F.col("factor") * F.col("impact")).alias("score"))
        seen = self._keep(self._best(partial, self.probe).select("item", "row"), "seen")
        return self._bounds(self.scores(seen))

    def candidates(self, bounds: np.ndarray) -> DataFrame:
        """Phase 2: item, row, score (a lower bound) and upper."""
        k, n_items = self.k, len(self.items)
        item, term, factor = (np.array([r[i] for r in self.lists], np.int64) for i in range(3))
        begin = np.searchsorted(item, np.arange(n_items + 1))
        cut = (bounds * self.share).astype(np.int64) // np.maximum(1, np.diff(begin))
        rest = np.maximum(0, cut - 1)
        least = -(-cut[item] // factor)
        floors = {}
        for t, x in zip(term.tolist(), least.tolist(), strict=True):
            floors[t] = min(x, floors.get(t, x))
        floors = F.broadcast(self.spark.createDataFrame(list(floors.items()), "term int, floor long"))
        above = self.index.join(floors, "term").where(F.col("impact") >= F.col("floor"))
        above = above.select(F.shiftright("row", BLOCK_BITS).alias("block"), "row", "term", "impact")

        def meet(block: pa.Table) -> pa.Table:
            terms = block["term"].to_numpy()
            by = np.argsort(terms, kind="stable")
            terms, rows, impact = terms[by], block["row"].to_numpy()[by], block["impact"].to_numpy()[by]
            first = rows.min() >> BLOCK_BITS << BLOCK_BITS
            starts, ends = np.searchsorted(terms, term), np.searchsorted(terms, term, "right")
            out = []
            for i in range(n_items):
                a, b = begin[i], begin[i + 1]
                sizes = ends[a:b] - starts[a:b]
                at = np.repeat(starts[a:b] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                adds = impact[at] * np.repeat(factor[a:b], sizes)
                over = adds >= cut[i]
                at, adds = rows[at[over]] - first, adds[over]
                lower, times = np.zeros(1 << BLOCK_BITS, np.int64), np.bincount(at, minlength=1 << BLOCK_BITS)
                np.add.at(lower, at, adds)
                upper = lower + rest[i] * (b - a - times)
                kth = max(bounds[i], np.partition(lower, -k)[-k] if k <= len(lower) else 0)
                keep = np.flatnonzero((lower > 0) & (upper >= kth))
                out.append((np.full(len(keep), i), keep + first, lower[keep], upper[keep]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.table({"item": cols[0].astype(np.int32), "row": cols[1], "score": cols[2], "upper": cols[3]})

        found = above.groupBy("block").applyInArrow(meet, "item int, row long, score long, upper long")
        return self._keep(found, "candidates")

    def ranked(self) -> DataFrame:
        """item_id, rank, doc_id, score."""
        bounds = self.first_bounds()
        found = self.candidates(bounds)
        bounds = np.maximum(bounds, self._bounds(found))
        floors = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(bounds)], "item int, floor long")
        # Phase 3
        pairs = found.join(F.broadcast(floors), "item").where(F.col("upper") >= F.col("floor")).select("item", "row")
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        best = self.scores(self._keep(pairs, "pairs")).where(F.col("score") > 0).withColumn("rank", F.row_number().over(by))
        best = self._keep(best.where(F.col("rank") <= self.k), "ranked")
        self.scratch.drop(*(f"{self.name}-{x}" for x in ("forward", "index", "seen", "candidates", "pairs")))
        return best.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, head: int = 100, probe: int = 100, share: float = 0.5) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank, doc_id, score; equal scores by doc_id, ids before null.

    Every row of docs is a document of its own: rows of one id may all be ranked, repeated ones next to each other; rows
    without an id count and are ranked as others. Null and empty texts have no terms. Equal rows of an item count once, different
    texts of one item_id are one query, items without an id are left out. An empty table gives an empty result. Other columns
    are ignored.

    head: postings of each list that the first phase reads; probe: documents that it looks up for each query; 0 < share <= 1.
    """
    if not 0 < share <= 1 or k < 1:
        raise ValueError("share lies above 0 and up to 1, k is 1 or more")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked-search")
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    queries = scratch.keep(query_terms(items), "queries")
    batches = max(1, -(-queries.count() // (BATCH // 2)))  # halved, as hashes do not deal evenly
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("item_id"), F.lit(batches)))
    item_type = queries.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(batches):
        run = Search(docs, queries.where(F.col("batch") == b).collect(), scratch, f"b{b}", k, head, max(k, probe), share)
        names = F.broadcast(spark.createDataFrame(list(enumerate(run.items)), f"item int, item_id {item_type}"))
        best = run.ranked().join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
