"""Reading and writing tables."""

from __future__ import annotations

import io
import json
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share: spark.checkpoint.dir, set here only where it is unset and all is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='tandem-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to a new folder of scratch_path: its lineage is cut there, and it outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, recursive: bool = False) -> DataFrame:
    """CSV files with a header, gzipped or not, under a given schema; `nan` and empty fields are NULL.

    Selecting columns of the result prunes the parse.
    """
    reader = spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("recursiveFileLookup", recursive)
    out = reader.csv(paths)
    for f in out.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out = out.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return out


def read_or_empty(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """As read_csv; an empty table where there are no files."""
    try:
        return read_csv(spark, paths, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_parquet_or_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`path`.parquet, or else `path`.csv."""
    try:
        return spark.read.schema(schema).parquet(f"{path}.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, f"{path}.csv", schema)


def read_arrays(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """.npy matrices as rows: path, row and values."""

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                table = np.load(io.BytesIO(content), allow_pickle=False)
                table = table.reshape(len(table), -1).astype("float32")
                for low in range(0, len(table), 4096):
                    part = table[low : low + 4096]
                    yield pd.DataFrame({"path": path, "row": np.arange(low, low + len(part)), "values": list(part)})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(rows, "path string, row long, values array<float>")


KEY = re.compile(r"(?P<task>.+)_split(?P<split_seed>\d+)_seed(?P<seed>\d+)\.npz$")


def read_paired_predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ZIP archives of .npz members `<task>_split<s>_seed<k>.npz`, as task, split_seed, seed, role, row, y, ref and alt."""

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not (m := KEY.match(name.rsplit("/", 1)[-1])):
                            continue
                        data = np.load(io.BytesIO(archive.read(name)), allow_pickle=False)
                        for role in ("val", "test"):
                            yield pd.DataFrame(
                                {
                                    "task": m["task"], "split_seed": int(m["split_seed"]), "seed": int(m["seed"]), "role": role,
                                    "row": data[f"{role}_indices"].astype("int64"), "y": data[f"y_{role}"].astype(float),
                                    "ref": data[f"ref_{role}"].astype(float), "alt": data[f"alt_{role}"].astype(float),
                                }
                            )

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInPandas(rows, "task string, split_seed int, seed int, role string, row long, y double, ref double, alt double")


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), kind: str = "parquet") -> None:
    """Parquet, or CSV with a header, in folders by column; complete once the folder has its _SUCCESS file."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """name and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def check_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and problem: files that are missing, changed or not listed."""
    a, b = found.alias("a"), manifest.alias("b")
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full")
    problem = F.when(F.col("a.name").isNull(), "missing").when(F.col("b.name").isNull(), "extra").when(F.col("a.sha256") != F.col("b.sha256"), "mismatch")
    return both.select(F.coalesce("a.name", "b.name").alias("name"), problem.alias("problem")).where("problem is not null")


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A summary as a Markdown table. A table of more than `rows` rows is data, not a summary, and raises."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def sidecar(values: dict) -> str:
    """Run metadata as JSON text."""
    return json.dumps(values, sort_keys=True, indent=1, default=str)
