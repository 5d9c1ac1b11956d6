"""Splitting, sampling and folds. Hashed modes are functions of the seed and the id, so they need no order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import half_even

from .ordered import running

Keys = Sequence[str]
PARTS = {"train": 0.8, "val": 0.1, "test": 0.1}


def hash_key(seed: int, item: Column) -> Column:
    """A number from 0 to 2^32 - 1 from the MD5 of seed and item."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), item.cast("string"))), 1, 8), 16, 10).cast("long")


def _placed(df: DataFrame, keys: Keys, seed: int, item: str) -> DataFrame:
    rows = df.withColumn("_key", hash_key(seed, F.col(item)).cast("double"))
    return running(rows, keys, "_key", {"_place": F.lit(1).cast("long")}, ties=[item]).drop("_key")


def random_split(df: DataFrame, keys: Keys, seed: int, item: str = "mol_id", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """`split` by hash order: sizes are truncated, the rest is test."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    rows = _placed(df, keys, seed, item).join(sizes, list(keys))
    part = F.when(F.col("_place") <= a, "train").when(F.col("_place") <= a + b, "val").otherwise("test")
    return rows.withColumn("split", part).drop("_place", "_n")


def subsample(df: DataFrame, keys: Keys, n: int, seed: int, item: str = "mol_id") -> DataFrame:
    """Exactly n rows of each group (all, if fewer), without replacement."""
    return _placed(df, keys, seed, item).where(F.col("_place") <= n).drop("_place")


def label_fraction(df: DataFrame, keys: Keys, label: str, fraction: float, seed: int, item: str = "mol_id") -> DataFrame:
    """Of each class the fraction, rounded half to even, one row at least; everything from 0.999 on."""
    if fraction >= 0.999:
        return df
    group = [*keys, label]
    sizes = df.groupBy(*group).agg(F.greatest(F.lit(1).cast("long"), half_even(F.count("*") * fraction)).alias("_take"))
    return _placed(df, group, seed, item).join(sizes, group).where(F.col("_place") <= F.col("_take")).drop("_place", "_take")


def folds(df: DataFrame, keys: Keys, n: int, seed: int, item: str = "mol_id", label: str | None = None) -> DataFrame:
    """`fold` from 0: places in hash order modulo n, within classes where a label is given."""
    group = [*keys, label] if label else list(keys)
    return _placed(df, group, seed, item).withColumn("fold", ((F.col("_place") - 1) % n).cast("int")).drop("_place")


def group_summary(df: DataFrame, keys: Keys, group: str, positive: Column | None = None, strata: str | None = None) -> DataFrame:
    """size and positives of each group; with strata, the sizes by stratum as a map."""
    extra = [F.sum(positive.cast("long")).alias("positives")] if positive is not None else []
    out = df.groupBy(*keys, group).agg(F.count("*").alias("size"), *extra)
    if strata:
        by = df.groupBy(*keys, group, strata).agg(F.count("*").alias("_n"))
        by = by.groupBy(*keys, group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(strata).cast("string"), "_n"))).alias("by_stratum"))
        out = out.join(by, [*keys, group])
    return out


def greedy_parts(sizes: Sequence[int], parts: Mapping[str, float] = PARTS) -> list[str]:
    """Groups in order fill the first part up to its share, then the next; the last takes what fits nowhere."""
    total, names, filled, out = sum(sizes), list(parts), dict.fromkeys(parts, 0), []
    for s in sizes:
        name = next((p for p in names[:-1] if filled[p] + s <= parts[p] * total), names[-1])
        filled[name] += s
        out.append(name)
    return out


def _targets(n: float, parts: Mapping[str, float]) -> np.ndarray:
    """Rounded shares of n, one at least; the last part has what is left."""
    sizes = [round(share * n) for share in list(parts.values())[:-1]]
    return np.maximum(1, [*sizes, n - sum(sizes)]).astype(float)


def balanced_parts(sizes: np.ndarray, positives: np.ndarray, seed: int = 0, parts: Mapping[str, float] = PARTS) -> list[str]:
    """Groups from the largest on (then by positives, then in seeded order), each to where it adds least.

    What it adds is overfilling (1.5) and the gaps to the targets of size (1), positives and negatives (0.75 each), as
    shares of the part's own targets. The weights are fixed values of the rule.
    """
    names, counts = list(parts), (sizes, positives, sizes - positives)
    targets = [_targets(c.sum(), parts) for c in counts]
    have, out = [np.zeros(len(names)) for _ in range(3)], [""] * len(sizes)
    order = list(range(len(sizes)))
    np.random.default_rng(seed).shuffle(order)
    for g in sorted(order, key=lambda g: (-sizes[g], -positives[g])):
        after = [h + c[g] for h, c in zip(have, counts, strict=True)]
        over = np.maximum(after[0] - targets[0], 0) / targets[0]
        size, pos, neg = (np.abs(a - t) / t for a, t in zip(after, targets, strict=True))
        at = int(np.argmin(1.5 * over + size + 0.75 * pos + 0.75 * neg))
        for h, c in zip(have, counts, strict=True):
            h[at] += c[g]
        out[g] = names[at]
    return out


def stratified_parts(table: np.ndarray, seed: int, parts: Mapping[str, float] = PARTS) -> list[str]:
    """Rows are groups, columns strata. Groups in seeded order go where size and strata are filled least.

    Overfilling counts a hundredfold, strata 0.35; noise below 1e-9 breaks ties. The weights are fixed values of the rule.
    """
    rng, names, n = np.random.default_rng(seed), list(parts), table.sum()
    target = np.maximum(1, [round(share * n) for share in list(parts.values())[:-1]])
    target = np.append(target, max(1, n - target.sum())).astype(float)
    goal = table.sum(0) * (target[:, None] / n)
    have, out = np.zeros_like(goal), [""] * len(table)
    order = list(range(len(table)))
    rng.shuffle(order)
    for g in order:
        after = have + table[g]
        fill = after.sum(1) / target
        label = (after / np.maximum(goal, 1)).mean(1)
        noise = np.array([rng.uniform(0, 1e-9) for _ in names])
        at = int(np.argmin(fill + 0.35 * label + 100 * np.maximum(fill - 1, 0) + noise))
        have[at] += table[g]
        out[g] = names[at]
    return out


def group_split(df: DataFrame, keys: Keys, group: str, mode: str = "greedy", seed: int = 0, positive: Column | None = None, strata: str | None = None) -> DataFrame:
    """`split` with no group in two parts. Only sizes of groups meet in a task; rows get their part by a join.

    greedy: largest first; balanced: largest first, also by share of positives; stratified: in seeded order, also by strata.
    """
    keys = list(keys)
    summary = group_summary(df, keys, group, positive if mode == "balanced" else None, strata if mode == "stratified" else None)
    kind = lambda c: df.schema[c].dataType.simpleString()
    fields = ", ".join(f"{k} {kind(k)}" for k in [*keys, group])

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        order, rise = (["size", group], [False, True]) if mode == "greedy" else ([group], [True])
        rows = rows.sort_values(order, ascending=rise, kind="stable").reset_index(drop=True)
        if mode == "greedy":
            parts = greedy_parts(rows["size"].tolist())
        elif mode == "balanced":
            parts = balanced_parts(rows["size"].to_numpy(float), rows["positives"].to_numpy(float), seed)
        else:
            names = sorted({k for m in rows["by_stratum"] for k in m})
            parts = stratified_parts(np.array([[m.get(k, 0) for k in names] for m in rows["by_stratum"]], float), seed)
        return rows[[*keys, group]].assign(split=parts)

    dealt = summary.groupBy(*keys).applyInPandas(deal, f"{fields}, split string")
    return df.drop("split").join(dealt, [*keys, group])


def dealt_folds(shapes: np.ndarray, times: np.ndarray, n: int) -> list[tuple[list[int], list[int]]]:
    """Deals groups one after the other to the fold that keeps the classes' shares most even: for every shape (a group's rows by class) the
    first groups' folds, and the cycle that all later ones follow.

    The fold of the least mean spread (the standard deviation over folds of each class's share) is taken, of equal ones that of fewest
    rows, then the first. The choice depends on how folds differ only; once n groups of one shape in a row went to n folds, they differ as
    before, so the same cycle follows for ever, however many groups there are.
    """
    have, whole = np.zeros((n, shapes.shape[1]), np.int64), np.maximum(1, (shapes * times[:, None]).sum(0))
    out = []
    for shape, m in zip(shapes, times.tolist(), strict=True):
        first: list[int] = []
        cycle: list[int] = []
        while len(first) < m:
            apart = have - have.min(0)
            tried = apart[None] + np.eye(n, dtype=np.int64)[:, :, None] * shape
            spread = (tried / whole).std(1).mean(1)
            at = min(range(n), key=lambda k: (round(spread[k], 12), apart[k].sum(), k))  # noqa: B023
            have[at] += shape
            first.append(at)
            if len(first) >= n and len(set(first[-n:])) == n:
                cycle = first[-n:]
                rounds, rest = divmod(m - len(first), n)
                have += rounds * shape
                have[cycle[:rest]] += shape
                break
        out.append((first, cycle))
    return out


def group_folds(df: DataFrame, keys: Keys, group: str, n: int, label: str | None = None) -> DataFrame:
    """`fold` with no group in two folds; with a label, the classes' shares are kept even. NULL groups and labels are values like others.

    Groups whose rows are most unequal over the classes are dealt first (without a label, the largest), into the fold where they do least harm
    (dealt_folds). Groups with equal numbers of rows by class are alike, so the driver sees how many there are of each kind and never the groups,
    and which of them goes where follows from its place among them.
    """
    keys = list(keys)
    kind = F.to_json(F.struct(F.col(label))) if label else F.lit("")
    cells = df.groupBy(*keys, group, kind.alias("_kind")).agg(F.count("*").alias("_n"))
    shaped = cells.groupBy(*keys, group).agg(F.array_sort(F.collect_list(F.struct("_kind", "_n"))).alias("_cells"))
    shaped = shaped.withColumn("_shape", F.to_json("_cells"))
    kinds = shaped.groupBy(*keys, "_shape").agg(F.count("*").alias("_times"), F.first("_cells").alias("_cells")).collect()
    by: dict[tuple, list] = {}
    for r in kinds:
        by.setdefault(tuple(r[k] for k in keys), []).append(r)
    plans = []
    for values, rows in by.items():
        names = sorted({c._kind for r in rows for c in r._cells})
        table = {r._shape: [dict((c._kind, c._n) for c in r._cells).get(x, 0) for x in names] for r in rows}
        unequal = lambda r: np.std(table[r._shape]) if len(names) > 1 else table[r._shape][0]  # noqa: B023, E731
        rows.sort(key=lambda r: (-round(float(unequal(r)), 12), [-x for x in table[r._shape]]))  # noqa: B023
        shapes = np.array([table[r._shape] for r in rows], np.int64)
        for r, (first, cycle) in zip(rows, dealt_folds(shapes, np.array([r._times for r in rows]), n), strict=True):
            plans.append((*values, r._shape, first, cycle))
    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    plans = df.sparkSession.createDataFrame(plans, f"{fields}_shape string, _first array<int>, _cycle array<int>")
    same = [*keys, "_shape"]
    at = running(shaped.select(*same, group).withColumn("_none", F.lit(0.0)), same, "_none", {"_at": F.lit(1).cast("long")}, ties=[group])
    at = at.join(plans, same)
    later = F.get("_cycle", F.pmod(F.col("_at") - 1 - F.size("_first"), F.greatest(F.lit(1), F.size("_cycle"))).cast("int"))
    fold = F.when(F.col("_at") <= F.size("_first"), F.get("_first", (F.col("_at") - 1).cast("int"))).otherwise(later)
    found = at.select(*keys, F.col(group).alias("_group"), fold.cast("int").alias("fold"))
    met = df.drop("fold").withColumn("_group", F.col(group))
    return met.join(found, [*[met[k] == found[k] for k in keys], met["_group"].eqNullSafe(found["_group"])]).select(*[met[c] for c in met.columns if c != "_group"], found["fold"])


def leaking_groups(df: DataFrame, keys: Keys, group: str) -> DataFrame:
    """Groups that are in more than one part; empty for a disjoint split."""
    return df.groupBy(*keys, group).agg(F.countDistinct("split").alias("parts")).where("parts > 1")


def dataset_card(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("split") == p).alias(f"n_{p}") for p in PARTS], F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"),
    )


def quantile_strata(df: DataFrame, keys: Keys, y: str, bins: int) -> DataFrame:
    """`stratum`: the number of inner quantile edges below y; equal edges count once."""
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile(y, inner)).alias("_edges"), F.min(y).alias("_low"))
    rows = df.join(edges, list(keys))
    below = F.filter("_edges", lambda e: (F.col(y) > e) & (e > F.col("_low")))
    return rows.withColumn("stratum", F.size(below)).drop("_edges", "_low")
