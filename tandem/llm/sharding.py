"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has `slots` equal positions; every shard owns `virtual_nodes` of them. A key hashes to a slot and goes to
the next virtual node clockwise; where that shard is full it continues clockwise to the first shard with room.
Keys arrive in the order (bucket, slot, hash, key). All keys of one (bucket, slot) cell prefer the shards in the
same order, so whether they fit follows from the cells' counts alone: Spark counts the cells (a fixed number, however
many rows there are), the driver walks over these counts and finds where each shard fills, and every row then looks
its cell up. At most one cell for each shard is split, by the rows' order within it. A cell of more than PART rows, as one of a
key that many rows have, is numbered in parts: rows are dealt out by a hash of their place in the table, parts are counted, and a
row's number is its number in its part after the rows of the parts before.

With slack 0 the capacities add up to the number of rows, so row counts differ by one at most; with a slack they are
ceil((1 + slack) * rows / shards), and fewer keys move when a shard is added.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SLOTS, BUCKETS = 4096, 64
#: Rows of a cell that one task numbers, on average.
PART = 16_384


def ring(shards: int, virtual_nodes: int = 128, slots: int = SLOTS) -> np.ndarray:
    """For every slot the shards in the order in which a key at that slot tries them."""
    nodes = sorted(
        (int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16) % slots, s)
        for s in range(shards)
        for v in range(virtual_nodes)
    )
    places = np.array([p for p, _ in nodes])
    owners = [s for _, s in nodes]
    order = np.empty((slots, shards), dtype=np.int32)
    for slot in range(slots):
        first = int(np.searchsorted(places, slot))
        seen = dict.fromkeys(owners[(first + i) % len(owners)] for i in range(len(owners)))
        order[slot] = list(seen)
    return order


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    if slack:
        return np.full(shards, math.ceil((1 + slack) * rows / shards), dtype=np.int64)
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def fill(counts: np.ndarray, order: np.ndarray, room: np.ndarray) -> pd.DataFrame:
    """Walks over the cells' counts in arrival order: which shard takes which rows of each cell.

    Returns cell, shard, first (the first row of the cell it takes, from 0), n and base (the shard's rows before).
    """
    slots = len(order)
    left, room = counts.astype(np.int64).copy(), room.astype(np.int64).copy()
    used = np.zeros(len(counts), dtype=np.int64)
    open_, at, pieces = room > 0, 0, []
    while left[at:].any():
        ranked = open_[order]
        target = np.where(ranked.any(1), order[np.arange(slots), ranked.argmax(1)], -1)
        where = target[np.arange(at, len(counts)) % slots]
        end, full = len(counts), -1
        for s in np.flatnonzero(open_):
            total = np.cumsum(np.where(where == s, left[at:], 0))
            i = int(np.searchsorted(total, room[s]))
            if i < len(total) and (at + i < end):
                end, full = at + i, int(s)
        stop = min(end + 1, len(counts))
        cells = np.arange(at, stop)
        take = left[at:stop].copy()
        if full >= 0:
            before = np.where(where[: end - at] == full, left[at:end], 0).sum()
            take[-1] = room[full] - before
        got = np.bincount(where[: stop - at], weights=take, minlength=len(room)).astype(np.int64)
        pieces.append(pd.DataFrame({"cell": cells, "shard": where[: stop - at], "first": used[at:stop], "n": take}))
        left[at:stop] -= take
        used[at:stop] += take
        room -= got
        open_ = room > 0
        at = end if full >= 0 else len(counts)
    out = pd.concat(pieces) if pieces else pd.DataFrame({"cell": [], "shard": [], "first": [], "n": []}, dtype=np.int64)
    out = out[out.n > 0].astype({"cell": "int32", "shard": "int32", "first": "int64", "n": "int64"})
    out["base"] = out.groupby("shard").n.cumsum() - out.n
    return out


def _numbered(rows: DataFrame, counts: np.ndarray, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds `_nth`, the row's number in its cell from 0. Cells of up to PART rows are numbered in the given order."""
    hot = np.flatnonzero(counts > PART)
    if not len(hot):
        nth = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
        return rows.withColumn("_nth", nth.cast("long"))
    spark = rows.sparkSession
    # a row's place has to be the same whenever it is computed, so it is taken from the table as written
    rows = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = F.broadcast(spark.createDataFrame([(int(c), int(-(-counts[c] // PART))) for c in hot], "_cell int, _parts long"))  # as many as cells, at most
    dealt = rows.join(parts, "_cell", "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), "_parts")))
    sizes = dealt.where("_parts is not null").groupBy("_cell", "_part").agg(F.count("*").alias("_n_part"))
    before = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cell", "_part", F.coalesce(F.sum("_n_part").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(*order, "_row")) - 1
    found = dealt.withColumn("_own", own).join(sizes, ["_cell", "_part"], "left")
    return found.withColumn("_nth", (F.col("_own") + F.coalesce("_start", F.lit(0))).cast("long")).drop("_own", "_start", "_part", "_parts", "_row")


def assign_shards(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", virtual_nodes: int = 128, slack: float = 0.0
) -> DataFrame:
    """Gives every row a shard and a gapless slot in it; keeps the key, the size and the CRC of the text.

    Every row counts: repeated keys take consecutive places at one slot, a null key hashes like an empty one, a null
    text has size 1 and the CRC of no bytes. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    rows = docs.select(
        F.col(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        number(9, 12).alias("_hash"),
        ((number(1, 4) % BUCKETS) * SLOTS + number(5, 4) % SLOTS).cast("int").alias("_cell"),
    )
    counts = np.zeros(SLOTS * BUCKETS, dtype=np.int64)
    # a row for each cell: BUCKETS * SLOTS at most, for any number of rows
    seen = docs.select(((number(1, 4) % BUCKETS) * SLOTS + number(5, 4) % SLOTS).cast("int").alias("_cell")).groupBy("_cell").count().toPandas()
    counts[seen["_cell"].to_numpy(dtype=np.int64)] = seen["count"].to_numpy(dtype=np.int64)
    pieces = fill(counts, ring(shards, virtual_nodes, SLOTS), capacities(int(counts.sum()), shards, slack))
    pieces = spark.createDataFrame(pieces, "_at int, shard int, _first long, _n long, _base long")
    rows = _numbered(rows, counts, ["_hash", key, "size", "text_crc32"], Scratch(spark, "sharding"))
    near = (F.col("_nth") >= F.col("_first")) & (F.col("_nth") < F.col("_first") + F.col("_n"))
    # as many pieces as cells and shards, at most
    return rows.join(F.broadcast(pieces), (F.col("_cell") == F.col("_at")) & near).select(
        key, "size", "text_crc32", "shard", (F.col("_base") + F.col("_nth") - F.col("_first")).alias("slot")
    )
