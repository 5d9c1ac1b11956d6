"""A training corpus from documents: quality, near-duplicates, repeated passages, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents; `run` writes what each returns as Parquet and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import byte_bpe, decontamination, line_quality, near_dedup, substring_dedup
from tandem.llm.common import Scratch, table

#: Documents that score less are rejected.
QUALITY = 0.3


def _apart(docs: DataFrame) -> DataFrame:
    """docs with private names for all columns but doc_id and text, so that none clashes with what a stage adds."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_column{i}" for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier, trained on those with labels, takes for bad."""
    model = line_quality.train(docs, table(spark, sf_dir, "labels"))
    own = _apart(docs)
    return line_quality.score_documents(own, model).where(F.col("score") >= QUALITY).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates: of the lowest doc_id (null is last), then text hash.

    Rows without words are near nothing: they stay, but one row only of those with one doc_id.
    """
    scratch = Scratch(spark, "rows")
    own = _apart(docs)
    rows = scratch.keep(own.withColumn("_row", F.monotonically_increasing_id()), "rows")  # stored, so numbers stay
    found = scratch.keep(near_dedup.grouped(rows, carry=("_row",)).where("group is not null or doc_id is not null"), "found")
    found = found.withColumn("alone", F.when(F.col("group").isNull(), F.col("doc_id")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "_row")).getField("_row")
    kept = found.groupBy("group", "alone").agg(first.alias("_row")).select("_row")
    dropped = found.select("_row").join(kept.hint("merge"), "_row", "left_anti")
    return rows.join(dropped, "_row", "left_anti").select(*own.columns).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that an earlier place has; drops documents that nothing is left of."""
    own = _apart(docs)
    others = [c for c in own.columns if c not in ("doc_id", "text")]
    marked = own.withColumn("_null", F.col("text").isNull())
    kept = substring_dedup.remove_repeats(marked, extra=(*others, "_null"), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    left = kept.where((F.size("removed") == 0) | (F.trim(text) != ""))
    left = left.withColumn("text", F.when(~F.col("_null"), text))
    for c, name in zip(own.columns, docs.columns, strict=True):
        if name == "n_chars":
            left = left.withColumn(c, F.coalesce(F.length("text").cast(docs.schema[name].dataType), c))
    return left.select(*own.columns).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    dirty = judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    own = _apart(docs)
    return own.join(dirty, same, "left_anti").select(*own.columns).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every document that is left, how many they are, and hashes of the text and of the ids' bytes.

    Decoding gives the text again where both hashes are equal; a null text has no ids and counts as empty. Other columns stay, but text and n_chars; one that is called as what is added is replaced.
    """
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(_apart(docs)))
    added = {"n_tokens": F.size("ids").cast("long"), "ids": F.col("ids"), "text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256), "decoded_sha256": F.sha2("decoded", 256)}
    names = zip(coded.columns, docs.columns, strict=False)
    carried = [F.col(c).alias(name) for c, name in names if name.lower() not in ("text", "n_chars", *added)]
    return coded.select(*carried, *(v.alias(k) for k, v in added.items()))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: SQL cannot express the classifier, nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{n}")
        scratch.drop(f"stage{n - 2}")
    return docs
