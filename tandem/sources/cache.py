"""Features that are computed once: a cache keyed by what they are computed from.

An entry's key is the digest of its input row and of the parameters. What is asked for and not there is computed, in one go, and
appended as a batch of its own; a batch counts once its marker (_SUCCESS, which Spark writes last) is there, so a run that failed half-way leaves nothing
that is read. A second run with the same rows and parameters only reads, and of changed rows only those are computed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(columns: Sequence[str], parameters: dict) -> Column:
    """SHA-256 of the columns' values, with their names, and of the parameters; NULL differs from empty."""
    said = F.lit(json.dumps(parameters, sort_keys=True))
    return F.sha2(F.concat_ws("\n", said, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


def batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole batches."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = [s.getPath() for s in system.listStatus(root) if s.isDirectory()]
    return sorted(p.toString() for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def cached(rows: DataFrame, item: str, inputs: Sequence[str], compute: Callable[[DataFrame], DataFrame], path: str, parameters: dict | None = None) -> DataFrame:
    """rows with the features that compute(df) gives: from the cache, or computed and put there.

    compute gets `_key` and the inputs and returns `_key` and the features. Rows of equal inputs are computed once, whatever their ids; NULL inputs
    are inputs. It has to give one row for each: check_order tells whether it did.
    """
    spark, inputs = rows.sparkSession, list(inputs)
    keyed = rows.withColumn("_key", digest(inputs, parameters or {}))
    asked = keyed.select("_key", *inputs).dropDuplicates(["_key"])
    there = batches(spark, path)
    known = spark.read.parquet(*there) if there else None
    missing = asked.join(known.select("_key"), "_key", "left_anti") if known is not None else asked
    if not missing.isEmpty():
        compute(missing).write.parquet(f"{path}/batch-{uuid.uuid4().hex}")
        known = spark.read.parquet(*batches(spark, path))
    if known is None:
        known = compute(missing)
    features = [c for c in known.columns if c != "_key"]
    # two runs at a time may both have added an entry
    known = known.dropDuplicates(["_key"])
    kept = [c for c in rows.columns if c not in features]
    return keyed.join(known, "_key", "left").select(*kept, *features)


def check_order(rows: DataFrame, exported: DataFrame, item: str, place: str) -> DataFrame:
    """Where two tables that are to be aligned by place disagree: place, expected, found. Empty if all ids are in order.

    Places that only one table has, places that one has twice and ids that are NULL on one side are disagreements.
    """
    a = rows.groupBy(F.col(place).alias("place")).agg(F.first(item, True).alias("expected"), F.count("*").alias("_a"))
    b = exported.groupBy(F.col(place).alias("place")).agg(F.first(item, True).alias("found"), F.count("*").alias("_b"))
    both = a.join(b, "place", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")) | ~F.col("_a").eqNullSafe(F.col("_b")) | (F.col("_a") > 1)).select("place", "expected", "found")
