"""MinHash near-duplicates by an inverted join over signature coordinates.

Every different shingle set (copies are one class, which has a number) posts its number under each (coordinate, value) of its signature. A
pair at or above the similarity agrees on at least MATCH of COORDINATES coordinates but for a chance of
1.4 in 10^6 at the very threshold (less above it), so a class whose values are shared with anyone in fewer than MATCH coordinates has no
partner, and two partners meet under at least one of their (shared - MATCH + 1) rarest values: the prefix. Long lists
are skipped: they lie outside the prefix, and collisions are counted on the two signatures instead. Pairs with MATCH
collisions and sizes within bounds are confirmed on the full shingle sets. A shingle that only one candidate has is in
no intersection, so what a set shares with anyone bounds its similarity with everyone: sets that share too little have
no partner, and a pair must be within the bound of the set that shares less.

Only components are asked for, so a list of n near copies does not need its n * n pairs. First every member of a list
is compared with the list's lowest member, then with its highest among those still apart; members that are already
connected need no further look. What is left, members of one list in different components, is compared in full, in
blocks of bounded size whatever the list's length: a pair is judged under the least key that both have in their
prefixes, by its bounds, its collisions and its full sets, so only links leave a block. Sets beyond CARRIED shingles do
not travel with the lists; pairs with such a set leave the block and are confirmed by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import components

COORDINATES, MATCH = 64, 31
#: Members of a list that one task compares with as many others.
BLOCK = 1024
#: Shingles of a set up to which it travels with its lists.
CARRIED = 4096
#: Words a worker keeps the hashes of, before it forgets them all and starts again.
CACHE = 500_000

_FACTORS = np.random.default_rng(20).integers(0, 2**64, (2, COORDINATES), dtype=np.uint64)
_MULTIPLY, _FLIP = _FACTORS[0] | np.uint64(1), _FACTORS[1]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_known = _Hashes()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; with fewer words the sequence is one, without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):  # each place has an odd factor of its own; the whole is mixed below
        s = (s + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the least of a hash over the set; upper halves, as signed 32-bit numbers."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, ((shingles[i : i + 512, None] ^ _FLIP) * _MULTIPLY).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(width: int):
    @F.arrow_udf("n_shingles long, set_hash binary, signature array<int>")
    def sign(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t, width) for t in texts.to_pylist()]
        flat = np.concatenate([np.zeros(0, np.int32), *(signature(s) for s in sets)])
        ends = np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES
        columns = [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.ListArray.from_arrays(ends, flat),
        ]
        return pa.StructArray.from_arrays(columns, ["n_shingles", "set_hash", "signature"])

    return sign


def _sets(width: int):
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [shingle_set(t, width).view(np.int64) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *found]))

    return sets


def prefixes(classes: DataFrame, match: int) -> DataFrame:
    """key and id: each class under the rarest values that a partner must share with it."""
    at = F.posexplode("signature")
    posts = classes.select("id", at.alias("at", "value")).select(
        "id", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(2**31)).alias("key")
    )
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = posts.join(shared.hint("merge"), "key").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("posts"))
    lists = lists.where(F.size("posts") >= match)
    return lists.select("id", F.explode(F.slice("posts", F.lit(1), F.size("posts") - match + 1)).alias("post")).select("post.key", "id")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """id and n_shared: how many shingles of a set are in another set too."""
    spread = sets.select("id", F.explode("shingles").alias("shingle"))
    alone = spread.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("n_alone"))
    return sets.join(alone.hint("merge"), "id", "left").select("id", (F.size("shingles") - F.coalesce("n_alone", F.lit(0))).cast("long").alias("n_shared"))


def _bounds(a, b, shared_a, shared_b, similarity: int, least, greatest):
    """Whether sizes and shared sizes allow the similarity; for columns and for arrays."""
    most = least(shared_a, shared_b)
    return (100 * least(a, b) >= similarity * greatest(a, b)) & (100 * most >= similarity * (a + b - most))


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, match: int, similarity: int) -> DataFrame:
    """The pairs (a, b) that collide often enough, are within bounds and are similar on their full sets."""
    side = lambda t, x, c: t.select(F.col("id").alias(x), *(F.col(k).alias(k + x) for k in c)).hint("merge")
    cs = ["n_shingles", "n_shared", "signature"]
    near = pairs.join(side(classes, "a", cs), "a").join(side(classes, "b", cs), "b")
    same = F.size(F.filter(F.zip_with("signaturea", "signatureb", lambda x, y: x == y), lambda x: x))
    fits = _bounds(F.col("n_shinglesa"), F.col("n_shinglesb"), F.col("n_shareda"), F.col("n_sharedb"), similarity, F.least, F.greatest)
    near = near.where(fits).where(same >= match).select("a", "b")
    near = near.join(side(sets, "a", ["shingles"]), "a").join(side(sets, "b", ["shingles"]), "b")
    both = F.size(F.array_intersect("shinglesa", "shinglesb"))
    union = F.size("shinglesa") + F.size("shinglesb") - both
    return near.where(100 * both >= similarity * union).select("a", "b")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


#: Pairs whose signatures are compared at a time.
PAIRS = 1 << 16
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins and ends."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _across(match: int, similarity: int):
    """From rows in the order of key, i and j: links between members of one block pair of a list, and pairs that are too large to be judged
    here (sure: false)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Whole block pairs, and where each begins and ends; one that a batch cuts waits for the rest."""
        held = None
        for batch in batches:
            if held is not None and len(held):
                batch = pa.concat_batches([held, batch])
            key, i, j = (batch[c].to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield batch.slice(0, last), np.concatenate([[0], new])
            held = batch.slice(last)
        if held is not None and len(held):
            yield held, np.array([0, len(held)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in groups(batches):
            whole = pa.Table.from_batches([batch]).combine_chunks().to_batches()[0]
            key, i, j, side, ids, labels, sizes, shared = (whole[c].to_numpy() for c in ("key", "i", "j", "side", "id", "label", "n_shingles", "n_shared"))
            signs = whole["signature"].flatten().to_numpy().reshape(len(whole), -1)
            carried = whole["shingles"].is_valid().to_numpy(zero_copy_only=False)
            sets, at_sets = _lists(whole["shingles"])
            keys, at_keys = _lists(whole["keys"])
            out: list[tuple[int, int, bool]] = []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = np.arange(low, high)
                left = rows[side[low:high] == 0]
                right = left if i[low] == j[low] else rows[side[low:high] == 1]
                if not len(left) or not len(right) or (right is left and len(left) < 2):
                    continue
                of = lambda x: (x[left][:, None], x[right][None, :])  # noqa: B023, E731
                fits = _bounds(*of(sizes), *of(shared), similarity, np.minimum, np.maximum)
                fits &= labels[left][:, None] != labels[right][None, :]
                if right is left:
                    fits &= ids[left][:, None] < ids[left][None, :]
                x, y = np.nonzero(fits)
                x, y = left[x], right[y]
                for n in range(0, len(x), PAIRS):
                    near = (signs[x[n : n + PAIRS]] == signs[y[n : n + PAIRS]]).sum(1) >= match
                    for p, q in zip(x[n : n + PAIRS][near].tolist(), y[n : n + PAIRS][near].tolist(), strict=True):
                        mine, others = keys[at_keys[p] : at_keys[p + 1]], keys[at_keys[q] : at_keys[q + 1]]
                        if np.intersect1d(mine, others, assume_unique=True)[0] != key[low]:
                            continue
                        sure = bool(carried[p] and carried[q])
                        if sure:
                            both = _common(sets[at_sets[p] : at_sets[p + 1]], sets[at_sets[q] : at_sets[q + 1]])
                            if 100 * both < similarity * (sizes[p] + sizes[q] - both):
                                continue
                        out.append((min(ids[p], ids[q]), max(ids[p], ids[q]), sure))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], LINK.types[k]) for k in range(3)], schema=LINK)

    return compare


def _left_over(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, label of the lists that still hold several components."""
    known = labels.select(F.col("node").alias("id"), "label").hint("merge")
    posts = posts.join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = posts.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n")).where("l < h")
    return posts.join(mixed.select("key", "n").hint("merge"), "key")


def similar_links(classes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, match: int, similarity: int) -> DataFrame:
    """Edges (a, b) that connect all classes which are connected by links.

    classes: id, n_shingles, signature, and key and t1 of a text of the class. texts: key, t1, text.
    """
    posts = prefixes(classes, match)
    posts = scratch.keep(posts, "posts")
    wanted = classes.join(posts.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "key", "t1")
    # repeated rows have one text
    found = texts.join(wanted.hint("merge"), ["key", "t1"]).groupBy("key", "t1").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    sets = found.select("id", _sets(width)("text").alias("shingles"))
    sets = scratch.keep(sets, "sets")
    shared = shared_sizes(sets)
    classes = classes.drop("key", "t1").join(shared.hint("merge"), "id").where(100 * F.col("n_shared") >= similarity * F.col("n_shingles"))
    classes = scratch.keep(classes, "met")
    posts = scratch.keep(posts.join(classes.select("id").hint("merge"), "id", "left_semi"), "fit")
    edges, rest = None, posts
    for turn, lead in enumerate((F.min, F.max)):
        leads = rest.groupBy("key").agg(lead("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        stars = rest.join(leads.hint("merge"), "key").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        found = scratch.keep(_confirm(stars, classes, sets, match, similarity), f"stars{turn}")
        edges = found if edges is None else edges.unionByName(found)
        rest = scratch.keep(_left_over(posts, components(edges, scratch, f"turn{turn}_")), f"rest{turn}")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    carried = sets.select("id", F.when(F.size("shingles") <= CARRIED, F.array_sort("shingles")).alias("shingles"))
    members = rest.groupBy("id").agg(F.collect_set("key").alias("keys")).join(classes.hint("merge"), "id").join(carried.hint("merge"), "id")
    dealt = (
        rest.join(members.hint("merge"), "id")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "id", "label", "n_shingles", "n_shared", "signature", "keys", "shingles",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )
    # block pairs lie one after the other in a partition, so many small ones are read together
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = scratch.keep(ordered.mapInArrow(_across(match, similarity), "a long, b long, sure boolean"), "across")
    unsure = _confirm(across.where("not sure").select("a", "b").distinct(), classes, sets, match, similarity)
    more = scratch.keep(across.where("sure").select("a", "b").unionByName(unsure), "links")
    scratch.drop("posts", "fit", "rest0", "sets", "met")
    return edges.unionByName(more)


def grouped(docs: DataFrame, width: int = 5, similarity: int = 75, match: int = MATCH, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carry`, t1 (a hash of the text), n_shingles, group and component_id for every row of docs.

    group is one number for all rows that links or equal doc_ids connect, with a doc_id or without; rows without shingles
    have none. component_id is the smallest doc_id of the group, null if it has none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    t1 = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t1")
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"), t1, "text")
    signed = docs.select("doc_id", *carry, t1, _signatures(width)("text").alias("s")).select("doc_id", *carry, "t1", "s.*")
    signed = scratch.keep(signed, "signed")
    classes = signed.where("n_shingles > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("doc"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"), "t1")).alias("text"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    # numbered by doc_id, so that the lowest class of a group has the group's lowest doc_id
    classes = classes.orderBy(F.asc_nulls_last("doc"), "set_hash").withColumn("id", F.monotonically_increasing_id())
    classes = scratch.keep(classes.select("id", "set_hash", "doc", "text.key", "text.t1", "n_shingles", "signature"), "classes")
    edges = similar_links(classes.drop("set_hash", "doc"), texts, scratch, width, match, similarity)
    rows = signed.select("doc_id", *carry, "t1", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("h"))
    rows = rows.join(classes.select(F.col("set_hash").alias("h"), "id").hint("merge"), "h", "left").drop("h")
    rows = scratch.keep(rows, "rows")
    # the different texts of one doc_id are one document
    owned = rows.where("doc_id is not null and id is not null").select("doc_id", "id")
    several = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    same = owned.join(several.hint("merge"), "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct()
    labels = components(edges.unionByName(same), scratch, "all")
    named = classes.select("id", "doc").join(labels.select(F.col("node").alias("id"), "label").hint("merge"), "id", "left")
    named = named.select("id", "doc", F.coalesce("label", "id").alias("group"))
    heads = named.where(F.col("id") == F.col("group")).select("group", F.col("doc").alias("component_id"))
    named = named.select("id", "group").join(heads.hint("merge"), "group")
    found = rows.join(named.hint("merge"), "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", *carry, "t1", "n_shingles", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 75, match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; similarity in hundredths.

    component_id is the smallest doc_id that is reachable over links, kept marks the row of that doc_id. A null, empty
    or blank text has no shingles and no links. Rows with equal sets are one class, however many; repeated rows come
    out as often as they went in. Rows of one doc_id with different texts are one document with the links of each. A
    null doc_id never names a component: without a partner that has an id, component_id is null and kept false; its row
    takes part in links as any other. An empty table gives an empty result. Other columns are ignored.
    """
    found = grouped(docs, width, similarity, match)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
