"""Array files (.npy, and .npz archives of them) as a Spark data source that is read by ranges of rows and written by parts.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("arrays").load("file:///shared/features")
    df.select("values").write.format("arrays").mode("overwrite").save("file:///shared/features")

Reading: a partition is a range of rows of one array, so a file of any size is read by many tasks of bounded memory. Members of an
archive that are stored uncompressed are read by ranges, too; a compressed member is one partition, streamed batch by batch.
Writing: a task writes a part of PART bytes at a time, under a name that no other attempt has; the parts count once the driver has
written the manifest that lists them, so a failed or repeated task leaves nothing that is read. Paths are URIs that pyarrow's file
systems know; driver and executors have to reach them alike.
"""

from __future__ import annotations

import ast
import io
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Bytes of an array that one partition reads, that one batch holds, and that one written part holds, about.
RANGE, BATCH, PART = 32 << 20, 2 << 20, 32 << 20
FIELDS = "file string, member string, row long, values array<double>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Header:
    kind: np.dtype
    rows: int
    shape: tuple
    begin: int

    @property
    def row_bytes(self) -> int:
        return self.kind.itemsize * math.prod(self.shape)


def header(head: bytes) -> Header:
    """Of the first bytes of an array file. Objects and column-major matrices, whose rows lie apart, are refused."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = head[6] > 1
    size = struct.unpack("<I" if wide else "<H", head[8 : 12 if wide else 10])[0]
    begin = (12 if wide else 10) + size
    if begin > len(head):
        raise ValueError("the header is longer than expected")
    said = ast.literal_eval(head[begin - size : begin].decode("latin1" if head[6] < 3 else "utf-8"))
    kind, shape = np.dtype(said["descr"]), said["shape"]
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"arrays of {kind} are not read")
    if said["fortran_order"] and len(shape) > 1:
        raise ValueError("column-major arrays are not read")
    return Header(kind, shape[0] if shape else 1, tuple(shape[1:]), begin)


@dataclass
class Range(InputPartition):
    """Rows first to last of an array that begins at `begin` in the file; raw, or from a compressed member there."""

    path: str
    file: str
    member: str | None
    first: int
    last: int
    begin: int
    compressed: bool = False


def ranges(path: str, target: int = RANGE) -> list[Range]:
    """The partitions of a file, of all files of a folder, or of those that its manifest lists; by name, then member, then row."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [root]
    if info.type == fs.FileType.Directory:
        listed = f"{root}/{MANIFEST}"
        if system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_file(listed) as f:
                files = [f"{root}/{x}" for x in json.loads(f.read())["files"]]
        else:
            found = system.get_file_info(fs.FileSelector(root))
            files = sorted(x.path for x in found if x.path.endswith((".npy", ".npz")) and not x.base_name.startswith(("_", ".")))
    out = []
    for file in files:
        with system.open_input_file(file) as f:
            if not file.endswith(".npz"):
                out += _cut(path, file, None, header(f.read(1 << 16)), 0, target)
                continue
            with zipfile.ZipFile(f) as archive:
                members = sorted((m for m in archive.infolist() if m.filename.endswith(".npy")), key=lambda m: m.filename)
            for m in members:
                f.seek(m.header_offset)
                local = f.read(30)  # the name's and the extra field's lengths end the local header
                begin = m.header_offset + 30 + sum(struct.unpack("<HH", local[26:30]))
                name = m.filename.removesuffix(".npy")
                if m.compress_type == zipfile.ZIP_STORED:
                    f.seek(begin)
                    out += _cut(path, file, name, header(f.read(1 << 16)), begin, target)
                elif m.compress_type == zipfile.ZIP_DEFLATED:
                    out.append(Range(path, file, name, 0, -1, begin, True))
                else:
                    raise ValueError(f"{m.filename}: unknown compression")
    return out


def _cut(path: str, file: str, member: str | None, h: Header, offset: int, target: int) -> list[Range]:
    step = max(1, target // max(1, h.row_bytes))
    return [Range(path, file, member, a, min(h.rows, a + step), offset) for a in range(0, h.rows, step)]


def rows_of(part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = opened(part.path)
    with system.open_input_file(part.file) as f:
        f.seek(part.begin)
        if part.compressed:
            source = _Inflated(f)
            h = header(source.peek(1 << 16))
            source.read(h.begin)
            first, last, read = 0, h.rows, source.read
        else:
            h = header(f.read(1 << 16))
            first, last, read = part.first, part.last, f.read
            f.seek(part.begin + h.begin + first * h.row_bytes)
        step = max(1, BATCH // max(1, h.row_bytes))
        for a in range(first, last, step):
            n = min(step, last - a)
            raw = read(n * h.row_bytes)
            if len(raw) < n * h.row_bytes:
                raise ValueError(f"{part.file} ends before its last row")
            values = np.frombuffer(raw, h.kind).astype(float)
            ends = np.arange(n + 1, dtype=np.int32) * math.prod(h.shape)
            yield pa.record_batch(
                {
                    "file": pa.array([part.file] * n), "member": pa.array([part.member] * n, pa.string()), "row": pa.array(np.arange(a, a + n)),
                    "values": pa.ListArray.from_arrays(ends, values),
                }
            )


class _Inflated:
    """A compressed member as it is read, a little at a time."""

    def __init__(self, file):
        self.file, self.stream, self.held = file, zlib.decompressobj(-15), b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and not self.stream.eof:
            more = self.stream.unconsumed_tail or self.file.read(1 << 18)
            if not more:
                break
            self.held += self.stream.decompress(more, 1 << 20)
        return self.held[:n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.held = self.held[n:]
        return out


class ArrayFiles(DataSource):
    """Reads file, member, row and values (an array's row, flattened, as doubles); writes one column of numbers or of arrays of numbers."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema.fields) != 1:
            raise ValueError("one column is written")
        return ArrayWriter(self.options["path"], overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.path, self.range)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: its place, and the names and row sizes of its parts."""

    place: int
    files: list[str]
    sizes: list[int]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        place, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, held, size = Parts(place, [], []), [], 0

        def put() -> None:
            table = np.concatenate(held)
            name = f"part-{place:05d}-{len(out.files):05d}-{attempt}.npy"
            whole = io.BytesIO()
            np.save(whole, table, allow_pickle=False)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(whole.getbuffer())
            out.files.append(name)
            out.sizes.append(-1 if table.ndim == 1 else table.shape[1])

        for batch in iterator:
            if not len(batch):
                continue
            table = _table(batch.column(0))
            if held and table.shape[1:] != held[0].shape[1:]:
                raise ValueError("rows are of different lengths")
            held.append(table)
            size += table.nbytes
            if size >= PART:
                put()
                held, size = [], 0
        if held:
            put()
        return out

    def commit(self, messages: list[Parts | None]) -> None:
        """The manifest lists the parts in the order of the partitions; what an earlier one listed stays in front unless it is overwritten."""
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m), key=lambda m: m.place)
        if len({s for m in parts for s in m.sizes}) > 1:
            self.abort(messages)
            raise ValueError("rows are of different lengths")
        before, listed = [], f"{root}/{MANIFEST}"
        if system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_file(listed) as f:
                before = json.loads(f.read())["files"]
        files = ([] if self.overwrite else before) + [x for m in parts for x in m.files]
        fresh = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps({"files": files}).encode())
        system.move(fresh, listed)
        if self.overwrite:
            for x in before:
                system.delete_file(f"{root}/{x}")

    def abort(self, messages: list[Parts | None]) -> None:
        system, root = opened(self.path)
        for x in (x for m in messages if m for x in m.files):
            if system.get_file_info(f"{root}/{x}").type == fs.FileType.File:
                system.delete_file(f"{root}/{x}")


def _table(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a NULL cannot be written")
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    sizes = set(column.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError("rows are of different lengths")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a NULL cannot be written")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)
