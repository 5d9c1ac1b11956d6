"""What a chain of filters removes under every order of the filters, from a histogram of failure masks.

Every document gets a mask, one bit for each filter that it fails. The filters that look at one text are native
expressions; a repeated text fails where a smaller id has the same text, and a groupBy on the text supplies each
text's smallest id. Rows are then counted by part and mask, 32 cells a part for five filters, and all orders are
enumerated from the cells alone: how much an order removes at a step depends on masks only, so no order is ever run
over documents.

Texts travel as their SHA-256 digests. Rows are counted by digest and id before anything is joined, so a text that a third
of all rows share is many small keys in the join and one row a task in the groupBy.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: The filter that needs the other documents.
REPEATED = "E"
#: Keys over which rows without an id are spread where labels are joined.
SALTS = 256


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails A: under 100 words, B: under 80 % distinct words, C: over 10 % capitals, D: a symbol."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 10 * capitals.cast("long") > F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def masked(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask, n and a salt: rows of one text and id are counted together; the salt spreads rows without an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(text)
    mask = sum((F.when(c, F.lit(_bit(name))).otherwise(F.lit(0)) for name, c in fails.items()), F.lit(0))
    rows = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("alone")
    )
    rows = rows.groupBy("digest", "doc_id", "part", "alone").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    met = rows.join(first, ["digest", "doc_id"], "left")
    again = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("alone") + F.when(again, F.lit(_bit(REPEATED))).otherwise(F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(F.lit(0))
    return met.select("part", "doc_id", mask.alias("mask"), "n", salt.alias("salt"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: the cells, at most 32 a part. Of several labels of an id the greatest counts."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    met = masked(docs).join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    count = lambda c: F.sum(F.when(c == 1, F.col("n")).otherwise(F.lit(0))).cast("long")
    return met.groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), count(F.col("good")).alias("n_good"), count(F.col("toxic")).alias("n_toxic")
    )


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, counted from the cells; zeros are kept."""
    turns = [
        F.struct(
            F.lit("".join(order)).alias("filter_order"),
            F.lit(k + 1).alias("step"),
            F.lit(sum(map(_bit, order[:k]))).alias("before"),
            F.lit(_bit(name)).alias("own"),
        )
        for order in permutations(FILTERS)
        for k, name in enumerate(order)
    ]
    runs = F.explode(F.array(*turns)).alias("turn")
    by = cells.select("part", "mask", "n", "n_good", "n_toxic", runs).select("*", "turn.*")
    own = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    left = F.col("mask").bitwiseAND(F.col("before") + F.col("own")) == 0
    # a failing filter comes before the other failing ones in one of as many orders as filters fail
    share = F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count("mask"), F.lit(1))
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(F.lit(0))).cast("long")
    return by.groupBy("part", "filter_order", "step").agg(
        total(left).alias("kept"),
        total(own & ~gone).alias("removed"),
        total(own & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(own & ~gone, "n_good").alias("good_lost"),
        total(own & ~gone, "n_toxic").alias("toxic_lost"),
        F.sum(F.when(own, F.col("n") * share.cast("long")).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters interact in every part (lang; null and empty are one part) under all 120 orders.

    A null text is an empty one: it fails A and nothing else but E. Rows of one id and one text are no repeats of each other, as
    neither id is smaller; rows without an id neither repeat a text nor make another row a repeat. Every row counts,
    repeated ones too. An empty table has no parts. Documents without a label are neither good nor toxic. Columns
    other than doc_id, text, lang, quality and toxic are ignored, whatever their names.
    """
    cells = histogram(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    return orders(cells)
