"""Token ids in fixed-width bit-packed blocks, written in ascending key order and readable from any block.

File format: Parquet files in a folder of the shared store, one row for each block. `bits` is the least width that
holds the largest id of the vocabulary, `payload` the ids of whole documents one after the other, most significant
bit first, `keys` and `sizes` the documents in the block, `start` the ids before the block within its `part`. Parts
follow each other in key order. A block holds BLOCK ids, or one document if that is longer. numpy unpacks a block, or
any stretch of one, without a loop: id i lies at bits [i * bits, (i + 1) * bits).
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, small_batches
from .token_counts import byte_characters

VOCABULARY = "word_bpe_49k.json"
BLOCK = 1 << 16
#: Pieces and parts a worker keeps the ids of since it last set the older ones aside, and as many older ones.
PIECES, PARTS = 600_000, 50_000
#: Characters of a text up to which it is split into pieces at once.
LONG = 1_000_000
#: Below this character NFC changes nothing and lower case goes character by character, but may lead above it.
LATIN = "\u0250"


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    table = (ids.astype(np.uint32)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(table.astype(np.uint8)).tobytes()


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first to first + n of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f">u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    low, high = first * bits, (first + n) * bits
    table = np.unpackbits(np.frombuffer(payload, np.uint8)[low // 8 : -(-high // 8)])[low % 8 :][: n * bits]
    return table.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class Kept(dict):
    """What `make` gives for the latest keys; those not asked for lately are forgotten."""

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        self[key] = got = self.make(key) if got is None else got
        return got


def latin_characters() -> list[str]:
    """Those below LATIN whose lower case is below it, too."""
    return [c for c in map(chr, range(ord(LATIN))) if max(c.lower()) < LATIN]


def latin_splitter():
    """Splits a lower-cased text of latin_characters, as the tokenizer's pattern does."""
    kinds: dict[str, str] = {"L": "", "N": "", " ": ""}
    for c in map(chr, range(ord(LATIN))):
        kind = " " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, digits, blanks = kinds["L"], kinds["N"], kinds[" "]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blanks}{letters}{digits}]+").findall


class Words:
    """Ids (little-endian, `width` bytes each) of texts.

    A Latin text is lower-cased and split here, as by the tokenizer's own pattern, and only its pieces go through the
    library's model. The tokenizer drops white space and no piece spans it, so the ids of any other text are those of
    its parts between ASCII white space in a row; parts that are not Latin go through the library as a whole.
    """

    def __init__(self, vocabulary: bytes, width: int = 4):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.split, self.foreign = latin_splitter(), re.compile(f"[^{''.join(map(re.escape, latin_characters()))}]").search
        self.symbols, self.kind = byte_characters(), {2: "H", 4: "I"}[width]
        self.parts, self.pieces = Kept(self.of, PARTS), Kept(self.piece, PIECES)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def piece(self, text: str) -> bytes:
        mapped = text if text.isascii() and text.isprintable() else "".join(self.symbols[b] for b in text.encode())
        return self.packed([t.id for t in self.library.model.tokenize(mapped)])

    def latin(self, text: str) -> bool:
        return (text.isascii() or not self.foreign(text)) and not ("<" in text and any(t in text for t in self.special))

    def of(self, word: str) -> bytes:
        if not word or self.latin(word):
            return b"".join(map(self.pieces.__getitem__, self.split(word.lower())))
        return self.packed(self.library.encode(word, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        if len(text) <= LONG and self.latin(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))
        return b"".join(map(self.parts.__getitem__, re.split("[ \t\r\n]", text)))

    def ids(self, texts: list[str]) -> list[bytes]:
        return list(map(self.text, texts))


@functools.lru_cache(2)
def words(vocabulary: bytes, width: int) -> Words:
    return Words(vocabulary, width)


def vocabulary_size(vocabulary: bytes) -> int:
    j = json.loads(vocabulary)
    return 1 + max(max(j["model"]["vocab"].values()), *(t["id"] for t in j["added_tokens"]), 0)


def encode(docs: DataFrame, end_id: int | None, name: str = VOCABULARY, width: int = 4) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, unsigned, of `width` bytes: 4 or 2) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path(name), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # under 2 MB
    last = b"" if end_id is None else np.array([end_id], dtype=f"<u{width}").tobytes()

    @F.arrow_udf("binary")
    def to_ids(texts: pa.Array) -> pa.Array:
        return pa.array([x + last for x in words(vocabulary.value, width).ids([t or "" for t in texts.to_pylist()])], pa.binary())

    return docs.select("doc_id", to_ids("text").alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / width).cast("long"))


def write_packed(docs: DataFrame, folder: str, end_id: int | None = None, name: str = VOCABULARY, block: int = BLOCK) -> int:
    """Encodes docs and writes the blocks in ascending doc_id order; returns the width in bits.

    A null doc_id comes first; rows of one doc_id follow each other; a null text has the end id only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    with open(path(name), "rb") as file:
        bits = max(1, (vocabulary_size(file.read()) - 1).bit_length())
    width = 2 if bits <= 16 else 4
    encoded = scratch.keep(encode(docs, end_id, name, width).select("doc_id", "ids"), "encoded")
    key = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("bits", T.IntegerType()),
            T.StructField("keys", T.ArrayType(key)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType()),
        ]
    )

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, keys, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        to = to_arrow_schema(schema)

        def full():
            row = (part, start, bits, keys, [len(x) // width for x in held], pack(np.frombuffer(b"".join(held), f"<u{width}"), bits))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, to, strict=True)], schema=to)

        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and n + len(x) // width > block:
                    yield full()
                    start, keys, held, n = start + n, [], [], 0
                keys.append(k)
                held.append(x)
                n += len(x) // width
        if keys:
            yield full()

    ordered = encoded.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(to_blocks, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    scratch.drop("encoded")
    return bits


def read_packed(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    blocks = spark.read.parquet(folder)
    key = blocks.schema["keys"].dataType.elementType
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a row for each written part: as many as the writer had partitions, however large the corpus
    totals = totals.toPandas().sort_values("part")
    totals["before"] = totals.n.cumsum() - totals.n
    before = dict(zip(totals.part.tolist(), totals.before.tolist(), strict=True))
    schema = T.StructType(
        [T.StructField("doc_id", key), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(schema)
        for batch in batches:
            for i in range(len(batch)):
                b = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes = b["sizes"].values.to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = unpack(b["payload"].as_py(), b["bits"].as_py(), 0, int(ends[-1])).astype("<u4")
                first = before[b["part"].as_py()] + b["start"].as_py()
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b["keys"].values, pa.array(first + ends[:-1]), pa.array(sizes), rows.cast(pa.binary())], schema=to)

    return blocks.mapInArrow(to_rows, schema)


def pack_documents(docs: DataFrame, folder: str | None = None, end_id: int | None = None, name: str = VOCABULARY) -> DataFrame:
    """Writes docs to bit-packed files in ascending doc_id order and reads them back; see write_packed and read_packed.

    One row for each row of docs; an empty table gives empty files and an empty result; other columns are ignored.
    """
    folder = folder or Scratch(docs.sparkSession, "packed").path("blocks")
    write_packed(docs.select("doc_id", "text"), folder, end_id, name)
    return read_packed(docs.sparkSession, folder)
