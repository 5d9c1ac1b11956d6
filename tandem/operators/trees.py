"""Extremely randomised trees, grown level by level for all groups and trees at once.

A node draws some of its features and, for each, one cut between the least and the greatest value that its rows have; the cut
that tells the targets apart best is taken. Every row goes to every tree (there is no resampling). A level is one job: tasks
walk their rows down the trees so far and sum targets and ranges on both sides of every drawn cut, a grouped
aggregate adds the tasks' sums, and each node's best cut is chosen before anything reaches the driver, so the driver holds
the trees and never a row. The ranges of both sides come with the sums, so the children's cuts need no further pass.

Targets are summed as whole numbers (class counts, or values in steps of 2^-30 of the greatest), so sums in any order give
the same trees, and draws are hashes of seed, tree and node, so lost tasks repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.tables import scratch_path

Keys = Sequence[str]
#: Groups that are fitted together, at most; their trees lie on the driver.
GROUPS = 10_000
#: Rows times trees that a task walks at a time; arrays of so many numbers stay in a core's cache.
WALKED = 1 << 16
#: Bytes of sums and ranges that a task gathers over all its rows; more are passed on after each walk.
HELD = 1 << 27
#: Of those, the slots in a batch.
PASSED = 1 << 14
STEPS = 1 << 30


def draws(seed: int, tree: np.ndarray, node: np.ndarray, n: int, turn: int) -> np.ndarray:
    """n numbers in [0, 1) for each (tree, node); `node` is 1 for the root, 2i and 2i + 1 for the children of i."""
    mask = (1 << 64) - 1

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    start = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) & mask)
    x = mixed(mixed(start + tree.astype(np.uint64)) + node.astype(np.uint64))
    x = mixed(x[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def drawn_cuts(seed: int, tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every node m features that vary in it, -1 where fewer do, and their cuts: a value goes left up to the cut."""
    n = low.shape[1]
    order = np.where(high > low, draws(seed, tree, node, n, 1), 2.0)
    chosen = np.argsort(order, axis=1, kind="stable")[:, :m]
    at = np.arange(len(chosen))[:, None]
    varies = order[at, chosen] < 2
    cut = low + draws(seed, tree, node, n, 2) * (high - low)
    cut = np.minimum(cut, np.nextafter(high, low))[at, chosen]
    return np.where(varies, chosen, -1), cut


@dataclass
class Nodes:
    """All trees' nodes. The root of tree t of group g is g * trees + t; a node's children are left and left + 1; leaves have feature -1."""

    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, cut and left child by which a walk goes on; a leaf leads to itself, as nothing lies above its cut."""
        leaf = self.feature < 0
        return np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, np.inf, self.cut), np.where(leaf, np.arange(len(leaf)), self.left)

    def walk(self, group: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
        """Row by tree, the node that is reached."""
        at = group[:, None] * self.trees + np.arange(self.trees)
        flat, row = np.ascontiguousarray(x).ravel(), x.shape[1] * np.arange(len(x))[:, None]
        feature, cut, left = self.steps
        for _ in range(levels):
            f = feature.take(at)
            f += row
            right = flat.take(f) > cut.take(at)
            at = left.take(at)
            at += right
        return at


@dataclass
class Forest:
    keys: list[str]
    features: list[str]
    classes: list | None
    groups: list[tuple]
    medians: np.ndarray
    nodes: Nodes
    value: np.ndarray
    depth: int

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Adds `name`: the mean of the trees' values, an array of the classes' probabilities if there are classes; NULL in unknown groups."""
        nodes, value, medians, depth = self.nodes, self.value, self.medians, self.depth
        spark = df.sparkSession
        kept = spark.sparkContext.broadcast((nodes, value, medians))

        @F.arrow_udf("array<double>")
        def look(group: pa.Array, x: pa.Array) -> pa.Array:
            nodes, value, medians = kept.value
            known = group.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros((len(group), value.shape[1]))
            at = np.flatnonzero(known)
            g = group.filter(group.is_valid()).to_numpy()
            rows = filled(x.take(pa.array(at)), g, medians)
            for a in range(0, len(g), step := max(1, WALKED // nodes.trees)):
                out[at[a : a + step]] = value[nodes.walk(g[a : a + step], rows[a : a + step], depth)].mean(axis=1)
            ends = np.arange(0, out.size + 1, value.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, out.ravel(), mask=pa.array(~known))

        found = look(F.col("_g"), F.array(*[F.col(f).cast("double") for f in self.features]))
        out = _numbered(df, self.keys, self.groups).withColumn(name, found if self.classes else found[0])
        return out.select(*[c for c in df.columns if c != name], name)


def filled(x: pa.Array, group: np.ndarray, medians: np.ndarray) -> np.ndarray:
    """Row by feature, medians of the group in place of NULL and NaN."""
    return fill(matrix(x, medians.shape[1]), group, medians)


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Row by feature, NaN in place of NULL."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float, copy=False)


def fill(rows: np.ndarray, group: np.ndarray | int, medians: np.ndarray) -> np.ndarray:
    gone = np.isnan(rows)
    return np.where(gone, medians[group], rows) if gone.any() else rows


def _numbered(df: DataFrame, keys: Keys, groups: list[tuple]) -> DataFrame:
    """Adds the group's number `_g`, NULL for unknown groups."""
    if not keys:
        return df.withColumn("_g", F.lit(0))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    numbers = df.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{fields}, _g int")
    return df.join(F.broadcast(numbers), list(keys), "left")


def extra_trees(
    df: DataFrame, keys: Keys, features: Sequence[str], label: str | None, classes: Sequence | None = None, trees: int = 100, leaf: int = 3,
    depth: int = 12, tried: int | None = None, seed: int = 0, views: Sequence[tuple[Mapping, Column]] | None = None, complete: bool = False,
) -> Forest:
    """Fits a forest in every group.

    With classes the label is one of them and classes are weighted to count alike; a label that is none of them, and a
    NULL label, is left out. Without, the label is a number. A node of fewer than 2 * leaf rows or of one class is not
    split, nor one at the depth; no side has fewer than `leaf` rows. `tried` features are drawn (the square root of all). Missing
    features are replaced by the group's (approximate) median. Groups with a NULL key are left out.

    With `views` a row takes part in several groups, but is stored and read once: each view has values of some keys, which df then
    does not have, and its own label, NULL where the row takes no part. `complete` says that no feature is missing, neither here nor
    where the forest predicts, so that no median is taken.
    """
    keys, features = list(keys), list(features)
    views = [({}, F.col(label))] if views is None else list(views)
    own = [k for k in keys if k not in views[0][0]]
    d, m = len(features), tried or max(1, int(len(features) ** 0.5))
    spark = df.sparkSession
    clean = [F.when(~F.isnan(c), c) for c in (F.col(f).cast("double") for f in features)]
    x = F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in clean]).alias("_x")

    def target(c: Column) -> Column:
        if not classes:
            return F.when(~F.isnan(c.cast("double")), c.cast("double"))
        t = F.lit(None).cast("int")
        for i, known in enumerate(classes):
            t = F.when(c == F.lit(known), i).otherwise(t)
        return t

    targets = [target(c) for _, c in views]
    rows = df.where(F.coalesce(*targets).isNotNull())
    for k in own:
        rows = rows.where(F.col(k).isNotNull())
    owners = sorted(tuple(r) for r in rows.select(*own).distinct().limit(GROUPS + 1).collect()) if own else [()]
    kept = scratch_path(spark, "trees")
    if len(owners) <= GROUPS:
        _numbered(rows.select(*own, x, F.array(*targets).alias("_t")), own, owners).select("_g", "_x", "_t").write.parquet(kept)
        rows = spark.read.schema(f"_g int, _x array<double>, _t array<{'int' if classes else 'double'}>").parquet(kept)
        known = _facts(rows, len(views), d, len(classes or [])) if owners else []
    if len(owners) > GROUPS or len(known) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    key = lambda r: tuple((dict(zip(own, owners[r._g], strict=True)) | views[r["_view"]][0])[k] for k in keys)
    known = sorted(known, key=key)
    groups = [key(r) for r in known]
    table = lambda s: np.array([[r[f"{s}{i}"] for i in range(d)] for r in known]).reshape(len(known), d)
    low, high = table("lo"), table("hi")
    # of no number at all
    low, high = np.where(low > high, 0.0, low), np.where(low > high, 0.0, high)
    medians = np.zeros((len(known), d))
    if not complete:
        each = rows.select("_g", *[F.when(~F.isnan(F.col("_x")[i]), F.col("_x")[i]).alias(f"_f{i}") for i in range(d)], F.posexplode("_t").alias("_view", "_t")).where(F.col("_t").isNotNull())
        mid = each.groupBy("_g", "_view").agg(F.array(*[F.percentile_approx(f"_f{i}", 0.5, 10_000) for i in range(d)]).alias("mid")).collect()
        mid = {(r._g, r["_view"]): r.mid for r in mid}
        medians[:] = np.array([[v if v is not None else 0.0 for v in mid[r._g, r["_view"]]] for r in known]).reshape(len(known), d)
    scale = np.array([(r.most or 1.0) for r in known]) / STEPS if not classes else np.ones(len(known))
    K = len(classes) if classes else 2
    weights = np.array([[r.n / (K * r[f"n{i}"]) if r[f"n{i}"] else 0.0 for i in range(K)] for r in known]).reshape(len(known), K) if classes else np.ones((len(known), K))
    group_of = np.full((max(1, len(owners)), len(views)), -1)
    for i, r in enumerate(known):
        group_of[r._g, r["_view"]] = i
    told = Told(group_of, medians, scale, bool(classes))
    factors = F.broadcast(spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights)], "g int, " + ", ".join(f"w{i} double" for i in range(K))))

    # the roots; `sums` are class counts, or the number and the sum of targets
    n_roots = len(groups) * trees
    group, tree, heap = np.repeat(np.arange(len(groups)), trees), np.tile(np.arange(trees), len(groups)), np.ones(n_roots, np.int64)
    low, high = np.repeat(low, trees, 0), np.repeat(high, trees, 0)
    nodes = Nodes(trees, np.full(n_roots, -1, np.int32), np.zeros(n_roots), np.zeros(n_roots, np.int64))
    sums = np.zeros((n_roots, K), np.int64)
    if classes:
        sums[:] = np.repeat([[r[f"n{i}"] for i in range(K)] for r in known], trees, 0) if known else sums
    else:
        sums[:] = np.repeat(_totals(rows, told, len(groups)), trees, 0) if known else sums
    all_sums, of = [sums], [group]
    first = 0
    for level in range(depth):
        can = (sums.sum(1) >= 2 * leaf) & ((sums > 0).sum(1) > 1) if classes else sums[:, 0] >= 2 * leaf
        ids = np.flatnonzero(can)
        if not len(ids):
            break
        tried_f, tried_c = drawn_cuts(seed, tree[ids], heap[ids], low[ids], high[ids], m)
        best = _best_cuts(rows, factors, nodes, told, first + ids, group[ids].astype(np.int32), tried_f, tried_c, level, K, leaf, level + 1 < depth)
        if not len(best["slot"]):
            break
        slot, k = best["slot"], best["k"]
        at = ids[slot]
        nodes.feature[first + at] = tried_f[slot, k]
        nodes.cut[first + at] = tried_c[slot, k]
        nodes.left[first + at] = first + len(sums) + 2 * np.arange(len(at))
        side = lambda s, n: np.stack([np.stack([best[f"{s}{x}{i}"] for i in range(n)], 1) for x in "lr"], 1).reshape(-1, n)
        group, tree = np.repeat(group[at], 2), np.repeat(tree[at], 2)
        heap = (2 * heap[at][:, None] + np.arange(2)).ravel()
        first += len(sums)
        sums = side("s", K).astype(np.int64)
        if level + 1 < depth:
            low, high = side("lo", d), side("hi", d)
        more = len(sums)
        nodes = Nodes(trees, np.append(nodes.feature, np.full(more, -1, np.int32)), np.append(nodes.cut, np.zeros(more)), np.append(nodes.left, np.zeros(more, np.int64)))
        all_sums.append(sums)
        of.append(group)
    sums, of = np.concatenate(all_sums), np.concatenate(of)
    if classes:
        value = sums * weights[of]
        value = value / np.maximum(value.sum(1, keepdims=True), 1e-300)
    else:
        value = (sums[:, 1] / np.maximum(1, sums[:, 0]) * scale[of])[:, None]
    return Forest(keys, features, list(classes) if classes else None, groups, medians, nodes, value, depth)


def grouping(key: np.ndarray) -> np.ndarray:
    """An order that puts equal keys together, by 16 bits at a time, which numpy sorts by their digits."""
    by = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(key.max(initial=0)).bit_length(), 16):
        by = by[np.argsort(((key >> shift) & 0xFFFF).astype(np.uint16).take(by), kind="stable")]
    return by


@dataclass
class Sides:
    """Sums and ranges of rows by side: number (slot * tried + k) * 2 + right for the k-th drawn cut of a slot (a node that is split)."""

    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, sides: int, K: int, d: int) -> Sides:
        return cls(np.zeros((K, sides), np.int64), np.full((d, sides), np.inf), np.full((d, sides), -np.inf), np.zeros(sides, bool))

    def add(self, x: np.ndarray, t: np.ndarray, at: np.ndarray, slot_of: np.ndarray, tried_f: np.ndarray, tried_c: np.ndarray, classes: bool) -> None:
        """Adds rows; `at` is the node by row and tree, slot_of its slot or -1. Nothing is put in order: every row is added to its side."""
        slot = slot_of.take(at).ravel()
        (d, m), K = (x.shape[1], tried_f.shape[1]), len(self.parts)
        met = np.flatnonzero(slot >= 0)
        row = np.repeat(np.arange(len(x)), at.shape[1])
        if len(met) < len(slot):
            slot, row = slot.take(met), row.take(met)
        flat, columns, t = np.ascontiguousarray(x).ravel(), np.ascontiguousarray(x.T), np.ascontiguousarray(t, np.int64)
        start, values = row * d, [c.take(row) for c in columns] if len(self.low) else []
        targets, parts = t.take(row), self.parts.ravel()
        for k in range(m):
            f = tried_f[:, k].astype(np.int64).take(slot)
            part, use = slot, None
            if (f < 0).any():
                use = np.flatnonzero(f >= 0)
                part, f = slot.take(use), f.take(use)
            if not len(part):
                continue
            side = (part * m + k) * 2
            side += flat.take((start if use is None else start.take(use)) + f) > tried_c[:, k].take(part)
            target = targets if use is None else targets.take(use)
            if classes:
                np.add.at(parts, target * self.parts.shape[1] + side, 1)
            else:
                np.add.at(self.parts[0], side, 1)
                np.add.at(self.parts[1], side, target)
            for i, v in enumerate(values):
                v = v if use is None else v.take(use)
                np.minimum.at(self.low[i], side, v)
                np.maximum.at(self.high[i], side, v)
            self.seen[side] = True

    def columns(self, m: int) -> dict[str, np.ndarray]:
        """A row for each slot and cut with rows on any side."""
        cut = np.flatnonzero(self.seen.reshape(-1, 2).any(1))
        cols = {"slot": (cut // m).astype(np.int64), "k": (cut % m).astype(np.int32)}
        for right, name in enumerate("lr"):
            side = 2 * cut + right
            cols |= {f"s{name}{i}": part[side] for i, part in enumerate(self.parts)}
            cols |= {f"lo{name}{i}": low[side] for i, low in enumerate(self.low)}
            cols |= {f"hi{name}{i}": high[side] for i, high in enumerate(self.high)}
        return cols


@dataclass
class Told:
    """What tasks need to read stored rows: the group of each owner's view (-1: none), medians, and the step of each group's targets."""

    group_of: np.ndarray
    medians: np.ndarray
    scale: np.ndarray
    classes: bool

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, targets as whole numbers and the (unfilled) features, once for each view that a row takes part in."""
        owner, view, t, x = taken(batch, self.group_of.shape[1], self.medians.shape[1])
        group = self.group_of[owner, view]
        if self.classes:
            return group, t.astype(np.int64), x
        # to the nearest whole number, halves away from zero
        t = t / self.scale[group]
        whole = np.trunc(t)
        return group, (whole + np.where(np.abs(t - whole) >= 0.5, np.sign(t), 0.0)).astype(np.int64), x


def taken(batch: pa.RecordBatch, views: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, views, targets and features, once for each view that a row takes part in."""
    t = batch["_t"].flatten()
    part = np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False))
    row = part // views
    return batch["_g"].to_numpy().take(row), part - row * views, t.drop_null().to_numpy(), matrix(batch["_x"], d).take(row, axis=0)


def _facts(rows: DataFrame, views: int, d: int, K: int) -> list:
    """For each owner `_g` and `_view` the rows n, of each class n0 and on, the greatest target `most` and the features' ranges, lo above hi if all are missing."""
    whole = ["n", *[f"n{i}" for i in range(K)]]
    most = ["most", *[f"hi{i}" for i in range(d)]]
    least = [f"lo{i}" for i in range(d)]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, high, low = np.zeros((1 + K, 0), np.int64), np.zeros((1 + d, 0)), np.zeros((d, 0))
        for batch in batches:
            owner, view, t, x = taken(batch, views, d)
            at = owner.astype(np.int64) * views + view
            if (more := int(at.max(initial=-1)) + 1 - counts.shape[1]) > 0:
                counts, high, low = (np.append(a, np.full((len(a), more), v, a.dtype), axis=1) for a, v in ((counts, 0), (high, -np.inf), (low, np.inf)))
            np.add.at(counts[0], at, 1)
            for i in range(K):
                np.add.at(counts[1 + i], at, (t == i).astype(np.int64))
            np.maximum.at(high[0], at, np.abs(t).astype(float))
            for i in range(d):
                some = np.flatnonzero(~np.isnan(x[:, i]))
                np.minimum.at(low[i], at.take(some), x[some, i])
                np.maximum.at(high[1 + i], at.take(some), x[some, i])
        at = np.flatnonzero(counts[0])
        cols = {c: a[at] for names, table in ((whole, counts), (most, high), (least, low)) for c, a in zip(names, table, strict=True)}
        yield pa.record_batch({"_g": (at // views).astype(np.int32), "_view": (at % views).astype(np.int32), **cols})

    schema = "_g int, _view int, " + ", ".join([f"{c} long" for c in whole] + [f"{c} double" for c in [*most, *least]])
    sums = [F.sum(c).alias(c) for c in whole] + [F.max(c).alias(c) for c in most] + [F.min(c).alias(c) for c in least]
    return rows.mapInArrow(met, schema).groupBy("_g", "_view").agg(*sums).limit(GROUPS + 1).collect()


def _totals(rows: DataFrame, told: Told, n: int) -> np.ndarray:
    """Number and sum of targets of each group."""
    kept = rows.sparkSession.sparkContext.broadcast(told)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, n), np.int64)
        for batch in batches:
            group, t, _ = kept.value.read(batch)
            np.add.at(out[0], group, 1)
            np.add.at(out[1], group, t)
        g = np.flatnonzero(out[0])
        yield pa.record_batch({"g": g, "n": out[0, g], "t": out[1, g]})

    found = rows.mapInArrow(met, "g long, n long, t long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    out = np.zeros((n, 2), np.int64)
    out[found["g"].to_numpy()] = np.stack([found["n"].to_numpy(), found["t"].to_numpy()], 1)
    return out


def walks(batches: Iterator[pa.RecordBatch], told: Told, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups, targets and filled features of at most `rows` rows at a time, small batches put together, a group's rows side by side."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(told.read(batch))
            size += len(held[-1][0])
        if held and (batch is None or size >= rows):
            group, t, x = (np.concatenate(c) for c in zip(*held, strict=True))
            by = grouping(group)
            group, t = group.take(by), t.take(by)
            x = fill(x.take(by, axis=0), group, told.medians)
            for a in range(0, size, rows):
                yield group[a : a + rows], t[a : a + rows], x[a : a + rows]
            held, size = [], 0


def _best_cuts(rows, factors, nodes, told, ids, owner, tried_f, tried_c, level, K, leaf, ranged) -> dict[str, np.ndarray]:
    """For each node that has a cut which helps, the best one with both sides' sums and, if `ranged`, ranges, by slot."""
    spark, classes = rows.sparkSession, told.classes
    d = told.medians.shape[1] if ranged else 0
    slot_of = np.full(len(nodes.feature), -1, np.int64)
    slot_of[ids] = np.arange(len(ids))
    kept = spark.sparkContext.broadcast((nodes, told, slot_of, owner, tried_f, tried_c))
    names = ["slot", "k"] + [f"s{s}{i}" for s in "lr" for i in range(K)] + [f"{e}{s}{i}" for s in "lr" for i in range(d) for e in ("lo", "hi")]
    kinds = {"slot": "long", "k": "int", "g": "int"}
    schema = ", ".join(f"{n} {kinds.get(n, 'long' if n[0] == 's' else 'double')}" for n in ["g", *names])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, told, slot_of, owner, tried_f, tried_c = kept.value
        n, m = tried_f.shape
        whole = 2 * n * m * (8 * (K + 2 * d) + 1) <= HELD
        sides = Sides.of(2 * n * m if whole else 0, K, d)

        def passed(sides: Sides) -> Iterator[pa.RecordBatch]:
            cols = sides.columns(m)
            for a in range(0, len(cols["slot"]), PASSED):
                part = {name: cols[name][a : a + PASSED] for name in names}
                yield pa.record_batch({"g": owner[part["slot"]], **part})

        for group, t, x in walks(batches, told, max(1, WALKED // nodes.trees)):
            at = nodes.walk(group, x, level)
            if whole:
                sides.add(x, t, at, slot_of, tried_f, tried_c, classes)
                continue
            # only the slots that these rows meet, numbered anew
            own = np.unique(slot_of.take(at))
            own = own[own >= 0]
            few, renumbered = Sides.of(2 * len(own) * m, K, d), np.full(n + 1, -1, np.int64)
            renumbered[own] = np.arange(len(own))
            few.add(x, t, at, renumbered[slot_of], tried_f[own], tried_c[own], classes)
            cols = few.columns(m)
            yield pa.record_batch({"g": owner[own[cols["slot"]]], **{name: own[cols[name]] if name == "slot" else cols[name] for name in names}})
        if whole:
            yield from passed(sides)

    found = rows.mapInArrow(met, schema).groupBy("g", "slot", "k")
    sums = [F.sum(n).alias(n) for n in names if n[0] == "s" and n != "slot"]
    ranges = [(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in names if n[:2] in ("lo", "hi")]
    found = found.agg(*sums, *ranges)
    if classes:
        found = found.join(factors, "g")
        mass = lambda s: sum((F.col(f"w{i}") * s(i) for i in range(1, K)), F.col("w0") * s(0))
        square = lambda s: sum(((F.col(f"w{i}") * s(i)) ** 2 for i in range(1, K)), (F.col("w0") * s(0)) ** 2)
        worth = lambda s: F.coalesce(F.try_divide(square(s), mass(s)), F.lit(0.0))
        size = lambda x: sum((F.col(f"s{x}{i}") for i in range(1, K)), F.col(f"s{x}0"))
    else:
        worth = lambda s: F.coalesce(F.try_divide(s(1).cast("double") * s(1).cast("double"), s(0).cast("double")), F.lit(0.0))
        size = lambda x: F.col(f"s{x}0")
    whole = worth(lambda i: F.col(f"sl{i}") + F.col(f"sr{i}"))
    gain = worth(lambda i: F.col(f"sl{i}")) + worth(lambda i: F.col(f"sr{i}")) - whole
    found = found.where((size("l") >= leaf) & (size("r") >= leaf)).withColumn("gain", gain).where(F.col("gain") > 1e-12 * whole)
    # the first of equal ones; gains of whole numbers are the same in every run
    best = found.groupBy("slot").agg(F.max_by(F.struct(*names[1:]), F.struct("gain", -F.col("k"))).alias("best"))
    found = best.select("slot", "best.*").toArrow().sort_by("slot")
    return {n: found[n].to_numpy() for n in found.column_names}
