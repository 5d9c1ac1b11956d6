"""Samples of this machine's resources as a streaming source.

    spark.dataSource.register(ResourceSampler)
    spark.readStream.format("resources").option("log", "file:///shared/samples").load()

The driver takes a sample whenever the stream asks for what is new and appends it to a log in the shared folder, one file a sample, before its
number is given out; an offset is the number of samples. Any range of offsets can be read again from the log, so a restarted stream goes on
where its checkpoint ends, without a loss and without repeats.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tandem.sources.arrays import opened

FIELDS = "number long, ts timestamp, kind string, value double"
#: Samples that one partition reads.
SPAN = 1000


def measured() -> dict[str, float]:
    """Load, memory in use and this process's memory, in MB, and its CPU seconds."""
    pages = os.sysconf("SC_PAGE_SIZE") / 1e6
    with open("/proc/self/statm") as f:
        own = int(f.read().split()[1]) * pages
    total, free = os.sysconf("SC_PHYS_PAGES") * pages, os.sysconf("SC_AVPHYS_PAGES") * pages
    spent = os.times()
    return {"load": os.getloadavg()[0], "memory_mb": total - free, "rss_mb": own, "cpu_s": spent.user + spent.system}


@dataclass
class Span(InputPartition):
    first: int
    last: int


class ResourceSampler(DataSource):
    """number, ts, kind and value: a row for each measured kind of every sample. Options: log (a folder that all share), seconds (between samples, 1)."""

    @classmethod
    def name(cls) -> str:
        return "resources"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SampleReader(self.options["log"], float(self.options.get("seconds", 1)))


class SampleReader(DataSourceStreamReader):
    def __init__(self, log: str, seconds: float):
        self.log, self.seconds = log, seconds

    def _file(self, number: int) -> str:
        return f"{opened(self.log)[1]}/{number:012d}.json"

    def _taken(self) -> int:
        """How many samples the log has: they are numbered without gaps, so the end is found by halving."""
        system = opened(self.log)[0]
        there = lambda n: system.get_file_info(self._file(n)).type == fs.FileType.File
        if not there(0):
            return 0
        low, high = 0, 1
        while there(high):
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if there(mid) else (low, mid)
        return high

    def _read(self, number: int) -> dict:
        with opened(self.log)[0].open_input_file(self._file(number)) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"samples": 0}

    def latestOffset(self) -> dict:
        system, root = opened(self.log)
        system.create_dir(root, recursive=True)
        taken = self._taken()
        if not taken or time.time() - self._read(taken - 1)["ts"] >= self.seconds:
            part = f"{root}/_{taken}"
            with system.open_output_stream(part) as f:
                f.write(json.dumps({"ts": time.time(), **measured()}).encode())
            system.move(part, self._file(taken))  # whole or not there
            taken += 1
        return {"samples": taken}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Span(a, min(a + SPAN, end["samples"])) for a in range(start["samples"], end["samples"], SPAN)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for n in range(partition.first, partition.last):
            sample = self._read(n)
            ts = int(sample.pop("ts") * 1e6)
            rows += [(n, ts, kind, float(v)) for kind, v in sorted(sample.items())]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.float64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["number", "ts", "kind", "value"])

    def commit(self, end: dict) -> None:
        """The log is kept, so that earlier offsets can be read again."""
