"""Projections of the given tables onto paired predictions, items, manifests and fingerprints, in Spark and in SQL.

Everything comes from integer arithmetic on ids, so both sides agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.tables import read_table

SEEDS = 5


def h(a: int, b: int, c: int, m: int) -> Column:
    """A fraction in [0, 1) from the order and the seed."""
    return ((F.col("o_orderkey") * a + F.col("seed") * b + c) % m).cast("double") / m


def h_sql(a: int, b: int, c: int, m: int) -> str:
    return f"(cast((o_orderkey * {a} + seed * {b} + {c}) % {m} AS DOUBLE) / {m})"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, task_type, seed, mol_id, group_key, split, fold_id, y, pred2d, pred3d and score for every order and seed."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = o.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    cls = F.col("o_orderstatus") == "P"
    part = (F.col("o_custkey") * 31 + 7) % 10
    y = F.when(cls, (F.col("o_totalprice") > 250000).cast("double")).otherwise(F.col("o_totalprice") / 100000.0)
    high = F.col("o_totalprice") > 250000
    a, b = h(7919, 104729, 13, 1009), h(6007, 15485, 29, 1013)
    return o.select(
        F.concat(F.lit("T_"), "o_orderstatus").alias("task"),
        F.when(cls, "classification").otherwise("regression").alias("task_type"),
        "seed",
        F.col("o_orderkey").alias("mol_id"),
        F.col("o_custkey").alias("group_key"),
        F.when(part < 8, "train").when(part == 8, "val").otherwise("test").alias("split"),
        ((F.col("o_custkey") * 17 + 3) % 5).cast("int").alias("fold_id"),
        y.alias("y"),
        F.when(cls, F.when(high, 0.55).otherwise(0.25) + 0.4 * a).otherwise(y + a - 0.5).alias("pred2d"),
        F.when(cls, F.when(high, 0.5).otherwise(0.3) + 0.4 * b).otherwise(y + 0.9 * (b - 0.5)).alias("pred3d"),
        h(3571, 65537, 5, 997).alias("score"),
        h(911, 7177, 3, 499).alias("cost"),
    )


PAIRED = f"""o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(unnest(range(0, {SEEDS})) AS INT) AS seed FROM orders),
y0 AS (
  SELECT *, o_orderstatus = 'P' AS cls, o_totalprice > 250000 AS high, (o_custkey * 31 + 7) % 10 AS part,
    CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice > 250000 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END
      ELSE o_totalprice / cast(100000 AS DOUBLE) END AS y,
    {h_sql(7919, 104729, 13, 1009)} AS a, {h_sql(6007, 15485, 29, 1013)} AS b FROM o
),
paired AS (
  SELECT 'T_' || o_orderstatus AS task, CASE WHEN cls THEN 'classification' ELSE 'regression' END AS task_type, seed, o_orderkey AS mol_id,
    o_custkey AS group_key, CASE WHEN part < 8 THEN 'train' WHEN part = 8 THEN 'val' ELSE 'test' END AS split,
    cast((o_custkey * 17 + 3) % 5 AS INT) AS fold_id, y,
    CASE WHEN cls THEN (CASE WHEN high THEN cast(0.55 AS DOUBLE) ELSE cast(0.25 AS DOUBLE) END) + cast(0.4 AS DOUBLE) * a
      ELSE y + a - cast(0.5 AS DOUBLE) END AS pred2d,
    CASE WHEN cls THEN (CASE WHEN high THEN cast(0.5 AS DOUBLE) ELSE cast(0.3 AS DOUBLE) END) + cast(0.4 AS DOUBLE) * b
      ELSE y + cast(0.9 AS DOUBLE) * (b - cast(0.5 AS DOUBLE)) END AS pred3d,
    {h_sql(3571, 65537, 5, 997)} AS score, {h_sql(911, 7177, 3, 499)} AS cost
  FROM y0
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, text, task (the language), group_key (the source), n_chars, quality and toxic of labelled documents."""
    d, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("mol_id"), "text", F.col("lang").alias("task"), F.col("source").alias("group_key"), "n_chars", "quality", "toxic"
    )


ITEMS = """items AS (
  SELECT doc_id AS mol_id, text, lang AS task, source AS group_key, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("mol_id"),
        F.concat(F.lit("U"), (F.col("user_id") % 6).cast("string")).alias("task"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("reason_"), (F.col("user_id") % 4).cast("string"))).alias("failure_reason"),
        F.col("value").alias("elapsed_sec"),
        F.when(F.col("user_id") % 7 != 0, F.col("value") / 10).alias("energy_min"),
        (F.col("user_id") % 11).cast("int").alias("rotatable"),
    )


MANIFEST = """manifest AS (
  SELECT event_id AS mol_id, 'U' || (user_id % 6) AS task, event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' THEN 'reason_' || (user_id % 4) END AS failure_reason, value AS elapsed_sec,
    CASE WHEN user_id % 7 <> 0 THEN value / 10 END AS energy_min, cast(user_id % 11 AS INT) AS rotatable
  FROM events
)"""


def experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows of paired with two costly experts: pred_rich, score_rich, pred_scalar and score_scalar."""
    p = paired(spark, sf_dir).where("split = 'test'")
    g = lambda a, b, c, m: ((F.col("mol_id") * a + F.col("seed") * b + c) % m).cast("double") / m
    return p.select(
        "task", "task_type", "seed", "mol_id", "y", "pred2d",
        F.col("pred3d").alias("pred_rich"), (g(1237, 911, 1, 101) - 0.4).alias("score_rich"),
        ((F.col("pred2d") + F.col("pred3d")) / 2).alias("pred_scalar"), (g(2203, 577, 7, 103) - 0.4).alias("score_scalar"),
    )


EXPERTS = (
    PAIRED
    + """,
experts AS (
  SELECT task, task_type, seed, mol_id, y, pred2d, pred3d AS pred_rich,
    cast((mol_id * 1237 + seed * 911 + 1) % 101 AS DOUBLE) / 101 - cast(0.4 AS DOUBLE) AS score_rich,
    (pred2d + pred3d) / 2 AS pred_scalar, cast((mol_id * 2203 + seed * 577 + 7) % 103 AS DOUBLE) / 103 - cast(0.4 AS DOUBLE) AS score_scalar
  FROM paired WHERE split = 'test'
)"""
)


def members(spark: SparkSession, sf_dir: str, split: str = "val") -> DataFrame:
    """task, task_type, seed, mol_id, y, member and pred: both predictors and two mixtures."""
    p = paired(spark, sf_dir).where(F.col("split") == split)
    all_ = F.array(
        *[
            F.struct(F.lit(n).alias("member"), c.alias("pred"))
            for n, c in (
                ("a2d", F.col("pred2d")),
                ("b3d", F.col("pred3d")),
                ("mean", (F.col("pred2d") + F.col("pred3d")) / 2),
                ("tilted", 0.25 * F.col("pred2d") + 0.75 * F.col("pred3d")),
            )
        ]
    )
    return p.select("task", "task_type", "seed", "mol_id", "y", F.inline(all_))


MEMBERS = (
    PAIRED
    + """,
members AS (
  SELECT task, task_type, seed, mol_id, split, y, 'a2d' AS member, pred2d AS pred FROM paired
  UNION ALL SELECT task, task_type, seed, mol_id, split, y, 'b3d', pred3d FROM paired
  UNION ALL SELECT task, task_type, seed, mol_id, split, y, 'mean', (pred2d + pred3d) / 2 FROM paired
  UNION ALL SELECT task, task_type, seed, mol_id, split, y, 'tilted', cast(0.25 AS DOUBLE) * pred2d + cast(0.75 AS DOUBLE) * pred3d FROM paired
)"""
)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


CHEAP, COSTLY = ("c_chars", "c_source", "c_lines"), ("g_capital", "g_symbol", "g_distinct", "g_long")


def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, task_type, seed, mol_id, split, fold_id, y, cheap features (CHEAP) and costly ones (COSTLY), which need the whole text's words.

    Tasks by language: Q_ is a document's quality label, D_ its share of distinct words, which is then no feature.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    share = lambda a, b: a.cast("double") / F.greatest(F.lit(1), b).cast("double")
    gone = lambda kept: F.length(F.regexp_replace(text, kept, ""))
    distinct = share(F.size(F.array_distinct(words)), F.size(words))
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.select(
        "doc_id", "lang", "quality", distinct.alias("distinct"), (F.length(text).cast("double") / 10000).alias("c_chars"),
        (F.substring("source", 4, 9).cast("double") / 20).alias("c_source"), (gone(r"[^\n]+").cast("double") / 100).alias("c_lines"),
        share(gone("[^A-Z]+"), F.length(text)).alias("g_capital"), share(gone("[^#$%&*|]+"), F.length(text)).alias("g_symbol"),
        (share(gone(r"[\x20\x09-\x0D]+"), F.size(words)) / 10).alias("g_long"),
    )
    kinds = F.array(
        F.struct(F.concat(F.lit("Q_"), "lang").alias("task"), F.lit("classification").alias("task_type"), F.col("quality").cast("double").alias("y"), F.col("distinct").alias("g_distinct")),
        F.struct(F.concat(F.lit("D_"), "lang").alias("task"), F.lit("regression").alias("task_type"), F.col("distinct").alias("y"), F.lit(0.0).alias("g_distinct")),
    )
    rows = d.select("*", F.inline(kinds)).where("y is not null").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    part = (F.col("doc_id") * 31 + F.col("seed") * 7 + 3) % 10
    return rows.select(
        "task", "task_type", "seed", F.col("doc_id").alias("mol_id"), F.when(part < 6, "train").when(part < 8, "val").otherwise("test").alias("split"),
        ((F.col("doc_id") * 17 + F.col("seed")) % 5).cast("int").alias("fold_id"), "y", *CHEAP, *COSTLY,
    )


MODALITIES = r"""texts AS (
  SELECT doc_id, lang, source, quality, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)
),
facts AS (
  SELECT doc_id, lang, cast(quality AS DOUBLE) AS quality, cast(len(list_distinct(w)) AS DOUBLE) / greatest(1, len(w)) AS distinct_share,
    cast(length(t) AS DOUBLE) / 10000 AS c_chars, cast(substring(source, 4) AS DOUBLE) / 20 AS c_source,
    cast(length(regexp_replace(t, '[^\n]+', '', 'g')) AS DOUBLE) / 100 AS c_lines,
    cast(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS DOUBLE) / greatest(1, length(t)) AS g_capital,
    cast(length(regexp_replace(t, '[^#$%&*|]+', '', 'g')) AS DOUBLE) / greatest(1, length(t)) AS g_symbol,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / greatest(1, len(w)) / 10 AS g_long
  FROM texts
),
modalities AS (
  SELECT task, task_type, seed, doc_id AS mol_id, y, c_chars, c_source, c_lines, g_capital, g_symbol, g_distinct, g_long,
    CASE WHEN (doc_id * 31 + seed * 7 + 3) % 10 < 6 THEN 'train' WHEN (doc_id * 31 + seed * 7 + 3) % 10 < 8 THEN 'val' ELSE 'test' END AS split
  FROM (
    SELECT *, 'Q_' || lang AS task, 'classification' AS task_type, quality AS y, distinct_share AS g_distinct FROM facts
    UNION ALL SELECT *, 'D_' || lang, 'regression', distinct_share, cast(0 AS DOUBLE) FROM facts
  ), (SELECT cast(unnest(range(0, 5)) AS INT) AS seed) WHERE y IS NOT NULL
)"""
