"""Removal of repeated byte strings by column-wise construction over aligned pieces of many documents.

Every `width`-byte window has one anchor in it, the leftmost of its least `core`-byte hashes, so equal windows have
equal anchors at equal places. Windows with one anchor follow each other; their bytes are a piece. Pieces whose anchor
hash occurs once have no repeated window and stay where they are. The others are dealt out by anchor hash, so that all
equal windows meet, and laid side by side with their anchors in one column. Then a positional Burrows-Wheeler order is
built column by column: each round inserts one symbol of every piece, re-sorts the pieces stably by it (so they stand
in the order of their reversed beginnings) and updates how far back neighbours agree. After a column, runs of
neighbours that agree over `width` symbols are equal windows; all but the first of a run, by document and start, are
removed. Rounds depend on the width only, not on the documents' lengths, and every array is passed through in order.

Anchor hashes with more than HOT pieces are salted. Each part is handled as above; what is left in a part, windows
that are the first of their kind there, meets the other parts' under the hash of the window itself.

Copies of a whole text need no search: in all but the first every window is a repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

WIDTH, CORE = 100, 32
#: Pieces that one task lays side by side, about.
BUCKET = 40_000
#: Pieces with one anchor hash up to which they are laid side by side as a whole.
HOT = 150_000
#: Whole copies up to which they are left out of the first pass by broadcasting their keys (16 bytes each).
BROADCAST_COPIES = 500_000
#: Pieces a task remembers having sent.
SENT = 500_000
LAST = 2**63 - 1

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers = {b: np.cumprod(np.full(1 << 12, b, np.uint64)) for b in (_BASE, _UNBASE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.full(2 * n, base, np.uint64))
    return _powers[base][:n]


def anchors(data: np.ndarray, width: int = WIDTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every run of windows with one anchor: its hash, the first window's start, the anchor's place in it, the number."""
    n = len(data)
    if n < width:
        return (np.zeros(0, np.int64),) * 4
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    x = (total[core:] - total[:-core]) * _power(_UNBASE, n - core + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low, at, size, span = x, np.arange(len(x), dtype=np.int32), 1, width - core + 1
    while size < span:  # least and leftmost of the last `size` hashes
        step = min(size, span - size)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        size += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return x[at[first]].view(np.int64), first, at[first] - first, np.diff(np.append(first, len(at)))


def _spots(width: int, core: int):
    """Rows (key, t1, text) to their anchors: hash, key, t1 and spot, which packs start, place and number."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(np.frombuffer(t.encode(), np.uint8), width, core) for t in batch.column("text").to_pylist()]
            sizes = [len(f[0]) for f in found]
            hashes, first, place, n = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(4))
            keys, marks = (np.repeat(batch.column(c).to_numpy().astype(np.int64), sizes) for c in ("key", "t1"))
            spot = (first << 14) | (place << 7) | n
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(keys), pa.array(marks), pa.array(spot)], ["hash", "key", "t1", "spot"])

    return find


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, half of what the shuffle's own compression leaves."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        data = pa.array([squeeze(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t1"), data], ["key", "t1", "data"])


def _pieces(width: int):
    """Cuts each document's pieces: hash, part, key, t1, at (the anchor), place, n, same and the bytes.

    `same` is a hash of the bytes. A task leaves out bytes that it has sent with the same anchor hash before; the row
    goes to the same bucket as the one that has them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            lists = batch.column("spots")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            hashes, parts, spots = (flat.field(i).to_numpy() for i in range(3))
            start, place, n = spots >> 14, (spots >> 7) & 127, spots & 127
            data, same, i = [], [], 0
            for packed, size in zip(batch.column("data").to_pylist(), sizes, strict=True):
                raw = unsqueeze(packed)
                for h, q, a, k in zip(*(c[i : i + size].tolist() for c in (hashes, parts, start, n)), strict=True):
                    piece = raw[a : a + k + width - 1]
                    mark = xxhash.xxh3_64_intdigest(piece) >> 1
                    same.append(mark)
                    if (h, q, mark) in sent:
                        data.append(None)
                    else:
                        if len(sent) < SENT:
                            sent.add((h, q, mark))
                        data.append(piece)
                i += size
            row = np.repeat(np.arange(len(sizes)), sizes)
            columns = [hashes, parts, *(batch.column(c).to_numpy()[row] for c in ("key", "t1")), start + place, place.astype(np.int32), n.astype(np.int32), np.array(same, np.int64)]
            for low in range(0, len(data), 1 << 14):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[low : low + (1 << 14)]) for c in columns), pa.array(data[low : low + (1 << 14)], pa.binary())],
                    ["hash", "part", "key", "t1", "at", "place", "n", "same", "piece"],
                )

    return cut


def repeated_windows(table: np.ndarray, first: np.ndarray, n: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """For aligned pieces: which windows (columns: their starts) also occur in a piece of lower rank at the same place.

    Piece i has windows first[i] to first[i] + n[i]. One pass for each column.
    """
    m, columns = table.shape
    order, since = np.arange(m), np.zeros(m, np.int64)
    out = np.zeros((m, columns - width + 1), bool)
    never = np.int64(m + 1)
    for k in range(columns):
        symbols = table[order, k]
        places = np.argsort(symbols, kind="stable")
        bounds = np.flatnonzero(np.diff(symbols[places], prepend=-1, append=-1))
        longest = np.empty(m, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mine = places[a:b]  # old places of the pieces with this symbol, ascending
            longest[a] = k + 1
            if b - a > 1:
                longest[a + 1 : b] = _maxima(since, mine)
        order, since = order[places], longest
        s = k - width + 1
        if s >= 0:
            mine = (first[order] <= s) & (s < first[order] + n[order])
            if mine.any():
                ranks = np.where(mine, rank[order], never)
                starts = np.flatnonzero(since > s)
                starts = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
                least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, m)))
                out[order, s] = mine & (ranks > least)
    return out


def _maxima(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The largest of values between each of the places (exclusive) and the next (inclusive)."""
    return np.maximum.reduceat(values[: places[-1] + 1], places[:-1] + 1)


def _lay_out(frame: pd.DataFrame, width: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of the pieces of one bucket, with the first window's column and the rank of every piece."""
    lead = width - core
    place, n = frame["place"].to_numpy().astype(np.int64), frame["n"].to_numpy().astype(np.int64)
    first, sizes = lead - place, n + width - 1
    table = np.zeros((len(frame), 2 * lead + core), np.uint8)
    data = np.frombuffer(b"".join(frame["piece"]), np.uint8)
    row = np.repeat(np.arange(len(frame)), sizes)
    column = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    table[row, column] = data
    keys, at = frame["key"].to_numpy(), frame["at"].to_numpy()
    by = np.lexsort((at, keys))
    new = np.concatenate([[False], (np.diff(keys[by]) != 0) | (np.diff(at[by]) != 0)])
    rank = np.empty(len(frame), np.int64)
    rank[by] = np.cumsum(new)
    return repeated_windows(table, first, n, rank, width), first, n


SPANS = "key long, t1 long, low long, high long, window binary"


def _search(width: int, core: int):
    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("hash", kind="stable")  # pieces that may agree stand together from the first round
        bytes_of = {k: v for k, v in zip(zip(frame["hash"], frame["same"], strict=True), frame["piece"], strict=True) if v is not None}
        frame["piece"] = [bytes_of[k] for k in zip(frame["hash"], frame["same"], strict=True)]
        found, first, n = _lay_out(frame, width, core)
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        keys, marks, at = (frame[c].to_numpy() for c in ("key", "t1", "at"))
        base = at[row] - (width - core)
        spans = pd.DataFrame({"key": keys[row], "t1": marks[row], "low": base + low, "high": base + high - 1 + width, "window": None})
        hot = np.flatnonzero(frame["part"].to_numpy() >= 0)
        if not len(hot):
            return spans
        columns = np.arange(found.shape[1])
        left = (columns >= first[hot, None]) & (columns < (first + n)[hot, None]) & ~found[hot]
        row, s = np.nonzero(left)
        pieces = frame["piece"].to_numpy()[hot]
        offset = s - first[hot][row]
        windows = [xxhash.xxh3_128_digest(pieces[r][o : o + width]) for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
        start = at[hot][row] - (width - core) + s
        firsts = pd.DataFrame({"key": keys[hot][row], "t1": marks[hot][row], "low": start, "high": start + width, "window": windows})
        return pd.concat([spans, firsts])

    return search


def repeated_spots(texts: DataFrame, width: int, core: int, hot: int, scratch: Scratch) -> DataFrame:
    """hash, part, key, t1 and spot of the anchors whose hash occurs more than once; part is -1 but for hot hashes."""
    spots = texts.select("key", "t1", "text").mapInArrow(_spots(width, core), "hash long, key long, t1 long, spot long")
    again = spots.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    again = scratch.keep(again, "again")  # a table of its own, so that adaptive execution may split a hot hash in the join
    part = F.when(F.col("times") > hot, F.pmod(F.xxhash64("key", "t1", "spot"), F.ceil(F.col("times") / hot)).cast("int")).otherwise(-1)
    return spots.join(again.hint("merge"), "hash").select("hash", part.alias("part"), "key", "t1", "spot")


def repeated_spans(texts: DataFrame, copies: DataFrame, spots: DataFrame, width: int, core: int, buckets: int) -> DataFrame:
    """key, t1, low, high: byte spans that repeat, and hashes of windows that are first in their part of a hot anchor."""
    lists = spots.groupBy("key", "t1").agg(F.collect_set(F.struct("hash", "part", "spot")).alias("spots"))
    firsts = _with(texts, copies, "left_anti")
    cut = _with(firsts, lists, "inner").select("key", "t1", "data", "spots")
    cut = cut.mapInArrow(_pieces(width), "hash long, part int, key long, t1 long, at long, place int, n int, same long, piece binary")
    own = F.when(F.col("part") >= 0, F.xxhash64("hash", "part")).otherwise(F.xxhash64("hash"))
    cut = cut.withColumn("bucket", F.pmod(own, F.lit(buckets)).cast("int"))
    return cut.groupBy("bucket").applyInPandas(_search(width, core), SPANS)


def _with(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins on key and t1, by which texts are dealt out."""
    other = other.withColumnsRenamed({"key": "_key", "t1": "_t1"}).hint("merge")
    return texts.join(other, (F.col("key") == F.col("_key")) & (F.col("t1") == F.col("_t1")), how).drop("_key", "_t1")


def _inward(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The largest span within a to b that cuts no UTF-8 character."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _keep(width: int, whole_characters: bool):
    """Rows (doc_id, data, copied, spans) to what is removed and what stays."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            spans, kept, n_bytes = [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("data", "copied", "spans")), strict=True):
                raw = unsqueeze(row[0])
                merged: list[list[int]] = []
                if row[1] and len(raw) >= width:
                    merged = [[0, len(raw)]]
                elif row[2]:
                    for a, b in sorted((s["low"], s["high"]) for s in row[2]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                if whole_characters:
                    merged = [[a, b] for a, b in (_inward(raw, a, b) for a, b in merged) if a < b]
                at, parts = 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                spans.append([{"low": a, "high": b} for a, b in merged])
                kept.append(b"".join([*parts, raw[at:]]))
                n_bytes.append(len(raw))
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("data", "copied", "spans")), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                [*(c for c in batch.schema.names if c not in ("data", "copied", "spans")), "n_bytes", "removed", "kept"],
            )

    return keep


def remove_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    core: int = CORE,
    bucket: int = BUCKET,
    hot: int = HOT,
    extra: tuple[str, ...] = (),
    whole_characters: bool = False,
) -> DataFrame:
    """Drops every byte that a `width`-byte string covers which also starts earlier in the collection.

    Returns doc_id, the `extra` columns, n_bytes, removed (maximal spans low to high) and kept (the bytes that stay), a
    row for each row of docs. With whole_characters no span begins or ends within a UTF-8 character: bytes of characters
    that only partly repeat stay. Earlier means in a smaller doc_id, or further left in the same one. A null text has no
    bytes. Null doc_ids come last and count as one document, as do rows of one doc_id; repeated rows do not remove each
    other, and all of them come out. Texts under `width` bytes stay. An empty table gives an empty result.
    """
    if width - core > 126 or not 0 < core <= width:
        raise ValueError("width may be longer than core by 126 at most")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col("text"), F.lit(""))
    t1 = F.coalesce(F.xxhash64("text"), F.lit(0))
    plain = docs.select(
        "doc_id", *extra, text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), t1.alias("t1")
    )
    whole = plain.select("key", "t1", F.xxhash64(F.lit("second"), "text").alias("t2"))
    first = whole.groupBy("t1", "t2").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("t1", "t2", "first")
    copies = whole.join(first.hint("merge"), ["t1", "t2"]).where("key > first").select("key", "t1").distinct()
    copies = scratch.keep(copies, "copies")
    searched = plain
    if copies.count() <= BROADCAST_COPIES:  # more of them are left out later, after their anchors were counted
        searched = plain.join(F.broadcast(copies), ["key", "t1"], "left_anti")
    spots = scratch.keep(repeated_spots(searched, width, core, hot, scratch), "spots")
    scratch.drop("again")
    n_spots, hottest = spots.agg(F.count("*"), F.max("part")).first()
    # one shuffle of the texts, by key and hash, serves the search and the removal
    texts = plain.select("key", "t1", "text").mapInArrow(_squeeze, "key long, t1 long, data binary").repartition("key", "t1")
    texts = texts.groupBy("key", "t1").agg(F.first("data").alias("data"))
    found = repeated_spans(texts, copies, spots, width, core, max(8, n_spots // bucket))
    if hottest is not None and hottest >= 0:
        # what was the first of its kind in one part of a hot anchor, against the other parts
        found = scratch.keep(found, "found")
        parts = found.where("window is not null")
        lowest = parts.groupBy("window").agg(F.min(F.struct("key", "low")).alias("lowest"), F.count("*").alias("n")).where("n > 1")
        later = parts.join(lowest.select("window", "lowest").hint("merge"), "window").where(F.struct("key", "low") > F.col("lowest"))
        found = found.where("window is null").drop("window").unionByName(later.select("key", "t1", "low", "high"))
    spans = found.groupBy("key", "t1").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    rows = plain.select("doc_id", *extra, "key", "t1")
    marked = _with(texts, copies.withColumn("copied", F.lit(True)), "left")
    marked = _with(_with(marked, spans, "left"), rows, "inner")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *extra))
    return marked.select("doc_id", *extra, "data", "copied", "spans").mapInArrow(
        _keep(width, whole_characters), f"{out}, n_bytes long, removed array<struct<low: long, high: long>>, kept binary"
    )
