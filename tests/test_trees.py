"""Distributed extra trees against a loop that grows one node after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import trees


def grown(x, t, tree, seed, m, leaf, depth, weights=None):
    """The value of every row in one tree, by recursion over plain rows; t are class numbers, or targets in steps."""
    value = [None] * len(x)

    def worth(rows):
        if weights is None:
            return sum(t[r] for r in rows) ** 2 / len(rows)
        mass = [w * sum(t[r] == c for r in rows) for c, w in enumerate(weights)]
        return sum(v * v for v in mass) / sum(mass) if sum(mass) else 0.0

    def split(rows, node, level):
        best = None
        if level < depth and len(rows) >= 2 * leaf and (weights is None or len({t[r] for r in rows}) > 1):
            low, high = ([f(x[r][i] for r in rows) for i in range(len(x[0]))] for f in (min, max))
            features, cuts = trees.drawn_cuts(seed, np.array([tree]), np.array([node]), np.array([low]), np.array([high]), m)
            for f, cut in zip(features[0], cuts[0], strict=True):
                if f < 0:
                    continue
                sides = [r for r in rows if x[r][f] <= cut], [r for r in rows if x[r][f] > cut]
                if min(map(len, sides)) >= leaf:
                    whole = worth(rows)
                    gain = worth(sides[0]) + worth(sides[1]) - whole
                    if gain > 1e-12 * whole and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, sides
        if best:
            for k, side in enumerate(best[1]):
                split(side, 2 * node + k, level + 1)
            return
        if weights is None:
            out = sum(t[r] for r in rows) / len(rows)
        else:
            mass = np.array([w * sum(t[r] == c for r in rows) for c, w in enumerate(weights)])
            out = mass / mass.sum()
        for r in rows:
            value[r] = out

    split(list(range(len(x))), 1, 0)
    return value


def table(seed, groups=2, n=90):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        for i in range(n):
            a, b, c = rng.gauss(0, 1), rng.randrange(4), rng.random()
            out.append((f"g{g}", i, a, b, c, 1.0, a * (b - 1) + 0.1 * rng.gauss(0, 1), 1 if a + c > 0.9 else 0 if rng.random() < 0.8 else 2))
    return out


COLUMNS = "task string, id int, a double, b int, c double, d double, u double, cls int"


@pytest.mark.parametrize("seed,depth", [(0, 12), (7, 3)])
def test_regression_against_a_loop(spark, seed, depth):
    rows = table(seed)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    forest = trees.extra_trees(df, ["task"], ["a", "b", "c", "d"], "u", trees=6, leaf=3, depth=depth, seed=seed, tried=2)
    got = {(r.task, r.id): r.pred for r in forest.predict(df).collect()}
    for task in ("g0", "g1"):
        mine = [r for r in rows if r[0] == task]
        most = max(abs(r[6]) for r in mine)
        x = [[float(v) for v in r[2:6]] for r in mine]
        t = [round(r[6] / (most / trees.STEPS)) for r in mine]
        want = np.mean([grown(x, t, k, seed, 2, 3, depth) for k in range(6)], axis=0) * most / trees.STEPS
        assert np.allclose([got[task, r[1]] for r in mine], want, atol=1e-9)
    residue = np.mean([(got[r[0], r[1]] - r[6]) ** 2 for r in rows]) / np.var([r[6] for r in rows])
    assert residue < (0.4 if depth == 12 else 0.9)


def test_balanced_classes_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(trees, "WALKED", 40)
    rows = table(3)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    forest = trees.extra_trees(df, ["task"], ["a", "b", "c", "d"], "cls", classes=[0, 1, 2], trees=5, leaf=2, depth=6, seed=11)
    got = {(r.task, r.id): r.p for r in forest.predict(df, "p").collect()}
    for task in ("g0", "g1"):
        mine = [r for r in rows if r[0] == task]
        t = [r[7] for r in mine]
        weights = [len(t) / (3 * t.count(c)) for c in range(3)]
        x = [[float(v) for v in r[2:6]] for r in mine]
        want = np.mean([grown(x, t, k, 11, 2, 2, 6, weights) for k in range(5)], axis=0)
        assert np.allclose([got[task, r[1]] for r in mine], want, atol=1e-9)
    assert all(math.isclose(sum(p), 1) for p in got.values())


def test_missing_values_unknown_groups_and_few_rows(spark):
    rows = [("a", i, float(i) if i % 5 else None, 0, float("nan"), 1.0, float(i > 10), int(i > 10)) for i in range(20)]
    rows += [("b", 0, 1.0, 1, 1.0, 1.0, 2.5, 1), ("c", 0, 1.0, 1, 1.0, 1.0, None, None), (None, 0, 1.0, 1, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    forest = trees.extra_trees(df, ["task"], ["a", "b", "c"], "u", trees=8, tried=1)
    got = {(r.task, r.id): r.pred for r in forest.predict(df).collect()}
    assert got["b", 0] == 2.5 and got["c", 0] is None and got[None, 0] is None
    assert got["a", 1] < 0.3 < 0.7 < got["a", 19]
    alone = trees.extra_trees(df, [], ["a"], "cls", classes=[0, 1], trees=3)
    assert all(abs(sum(r.pred) - 1) < 1e-9 for r in alone.predict(df).collect())
    none = trees.extra_trees(df.limit(0), ["task"], ["a"], "u", trees=2)
    assert none.predict(df).where(F.col("pred").isNotNull()).count() == 0


def test_sides_of_all_rows_of_a_task_are_passed_on_once(spark, monkeypatch):
    """A level passes on a row for each drawn cut and task, however many walks the task's rows take; beyond HELD after each walk, to the same trees."""
    df = spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in table(3)], "g string, i long, a double, b double, c double, d double, y double, z int").repartition(1)

    def fitted():
        f = trees.extra_trees(df, ["g"], ["a", "b", "c", "d"], "y", trees=5, leaf=2, depth=4)
        return f.nodes.feature.tolist(), f.nodes.cut.tolist(), f.value.tolist()

    want = fitted()
    monkeypatch.setattr(trees, "WALKED", 40)
    assert fitted() == want
    monkeypatch.setattr(trees, "HELD", 0)
    assert fitted() == want
    # without Spark: 3 walks of 8 rows each leave the sides of one
    x, t = np.arange(48.0).reshape(24, 2), np.arange(24)
    at, cuts = np.zeros((24, 1), int), (np.array([[0, 1]]), np.array([[11.0, 90.0]]))
    sides = trees.Sides.of(4, 2, 2)
    for a in range(0, 24, 8):
        sides.add(x[a : a + 8], t[a : a + 8], at[a : a + 8], np.array([0]), *cuts, False)
    got = sides.columns(2)
    assert got["slot"].tolist() == [0, 0] and got["k"].tolist() == [0, 1]
    assert got["sl0"].tolist() == [6, 24] and got["sr0"].tolist() == [18, 0] and got["sl1"].tolist() == [15, 276] and got["lor1"].tolist() == [13, np.inf]
    assert trees.grouping(np.array([70_000, 3, 70_000, 4_464])).tolist() == [1, 3, 0, 2]


def test_a_row_in_many_groups_is_stored_once(spark, monkeypatch):
    """Views of a row, each with its own target, grow the trees that copies of the row would, from one stored row."""
    rows = [(*r[:3], float(r[3]), *r[4:]) for r in table(5)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double, c double, d double, y double, z int").repartition(3)
    other = {0: F.col("y"), 1: F.when(F.col("i") % 3 != 0, -F.col("y") / 3)}
    copies = df.select("g", "i", "a", "b", "c", "d", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("t")) for k, c in other.items()])))
    kept = []
    path = trees.scratch_path
    monkeypatch.setattr(trees, "scratch_path", lambda *a: kept.append(path(*a)) or kept[-1])
    options = dict(trees=4, leaf=2, depth=4)
    want = trees.extra_trees(copies, ["g", "k"], ["a", "b", "c", "d"], "t", **options)
    got = trees.extra_trees(df, ["g", "k"], ["a", "b", "c", "d"], None, views=[({"k": k}, c) for k, c in other.items()], complete=True, **options)
    assert got.groups == want.groups and got.nodes.feature.tolist() == want.nodes.feature.tolist() and got.value.tolist() == want.value.tolist()
    assert spark.read.parquet(kept[-1]).count() == len(rows)
