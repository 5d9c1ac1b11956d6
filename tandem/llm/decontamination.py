"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `width` consecutive words of an item. A document holds a window only if it holds the window's rarest word
(a prefix of one word is enough where the whole window must be contained), so only that word is joined. Where a
document word meets a window's rarest word, the window's place in the document follows from the word's place in the
window; places that stick out at either end are dropped by their bounds, and the rest is verified by comparing the
words themselves inside the join, so a document's words are never copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: Digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the benchmark up to which its windows, `width` words for each of them at most, are broadcast.
#: The words are counted first; a larger benchmark is joined by shuffling.
BROADCAST_WORDS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _join(left: DataFrame, right: DataFrame, small: bool, on, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def rare_windows(docs: DataFrame, items: DataFrame, width: int, small: bool, scratch: Scratch) -> DataFrame:
    """token (the window's rarest), place (of the token in it), item_id, span and window, for windows that may occur."""
    tokens = items.select(F.explode("words").alias("token")).distinct()
    seen = docs.select(F.explode_outer(words(F.col("text"))).alias("token"))
    rarity = _join(seen, tokens, small, "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarity = scratch.keep(rarity, "rarity")
    span = F.least(F.lit(width), F.size("words"))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("start")
    cut = items.select("item_id", "words", span.alias("span"), starts)
    cut = cut.select("item_id", "span", F.slice("words", F.col("start") + 1, F.col("span")).alias("window")).distinct()
    spread = cut.select("*", F.posexplode("window").alias("place", "token")).join(rarity, "token")
    rarest = spread.groupBy("item_id", "span", "window").agg(F.min(F.struct("seen", "token", "place")).alias("rarest"), F.count("*").alias("known"))
    # a window with a word that no document has occurs nowhere
    return rarest.where(F.col("known") == F.col("span")).select("rarest.token", "rarest.place", "item_id", "span", "window")


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, item_id, start, span: every place where a window of an item occurs in a document."""
    scratch = scratch or Scratch(docs.sparkSession, "windows")
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = scratch.keep(items, "items")
    n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    small = n_words <= BROADCAST_WORDS
    windows = scratch.keep(rare_windows(docs, items, width, small, scratch), "windows")
    # explode_outer: an explode would have its input computed once more for a filter on its size
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("doc")).select(
        "doc_id", "text_hash", "doc", F.posexplode_outer("doc").alias("pos", "token")
    )
    if small:
        spread = spread.withColumn("cut", F.lit(0))
    else:  # the words move: each takes only its neighbourhood along
        low = F.greatest(F.lit(0), F.col("pos") - width + 1)
        spread = spread.where(F.col("token").isNotNull()).select(
            "doc_id", "text_hash", "token", "pos", low.alias("cut"), F.slice("doc", low + 1, 2 * width - 1).alias("doc")
        )
    start = F.col("pos") - F.col("cut") - F.col("place")  # of the window in doc, from 0
    fits = (start >= 0) & (start + F.col("span") <= F.size("doc")) & (F.slice("doc", F.greatest(start, F.lit(0)) + 1, F.col("span")) == F.col("window"))
    met = spread.withColumnRenamed("token", "word")
    on = (F.col("word") == F.col("token")) & fits
    met = met.join(F.broadcast(windows), on) if small else met.join(windows.hint("merge"), on)
    return met.select("doc_id", "text_hash", "item_id", "span", (F.col("pos") - F.col("place")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Which words of each document lie in a benchmark window, and of which items.

    One row for each row of docs; text_hash, xxhash64 of the text, tells rows of one doc_id apart. A null text has no words, an item without words has no windows, an empty benchmark
    hits nothing. Rows with one doc_id and different texts are judged apart; repeated rows get equal results. Windows
    of an item whose item_id is null hit words, but are not counted among the items. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.select("doc_id", "text")
    benchmark = benchmark.select("item_id", "text")
    hits = scratch.keep(find_windows(docs, benchmark, width, scratch).distinct(), "hits")
    places = hits.select("doc_id", "text_hash", "item_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)).alias("at"))
    marks = places.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.countDistinct("at").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    none = F.array().cast("array<string>")
    return base.join(
        marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left"
    ).select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
