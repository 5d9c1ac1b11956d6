"""Resource samples as a stream: the highest values of each kind in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Parquet files that appear in a folder; a time without zone is taken as the session's."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_peaks(stream: DataFrame, kind: str, value: str, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """start, kind, samples and peak; rows later than the watermark are dropped, closed windows are final."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), kind)
    return grouped.agg(F.count("*").alias("samples"), F.max(value).alias("peak")).select(F.col("w.start").alias("start"), kind, "samples", "peak")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Processes what is there and stops. A repeated batch changes nothing: a complete table is replaced, and what a
    batch appends has a folder of its own, `batch=<number>`, which the batch replaces when it is run again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
