"""Fusion and router objectives against their definitions."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import fusion, routers, trees

KEYS = ["task", "task_type", "seed"]


def blocks(n=240):
    """A table of two tasks: the costly feature tells what the cheap one only hints at."""
    rng = random.Random(4)
    out = []
    for task, kind in (("c", "classification"), ("r", "regression")):
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            y = a + 2 * b if kind == "regression" else float(a + 2 * b + rng.gauss(0, 0.3) > 0)
            out.append((task, kind, 0, i, ("train", "train", "val", "test")[i % 4], y, a, a + b, 0.5 * b, rng.random()))
    return out


COLUMNS = "task string, task_type string, seed int, mol_id long, split string, y double, c1 double, c2 double, g1 double, g2 double"


@pytest.fixture(scope="module")
def fused(spark):
    df = spark.createDataFrame(blocks(), COLUMNS).repartition(3)
    return df, fusion.fuse(df, KEYS, ["c1"], ["g1", "g2"], trees=15, depth=6).toPandas()


def test_variants_see_their_blocks(spark):
    df = spark.createDataFrame(blocks(8), COLUMNS)
    rows = fusion.variant_rows(df, ["c1"], ["g1", "g2"], True).toPandas()
    by = {v: g for v, g in rows.groupby("variant")}
    assert {v: len(g) for v, g in by.items()} == {"cheap": 16, "costly": 16, "early": 16, "dropped": 32}
    assert (by["cheap"][["g1", "g2"]] == 0).all(axis=None) and (by["costly"].c1 == 0).all() and (by["early"].c1 != 0).all()
    assert ((by["dropped"].g1 == 0) == (by["dropped"].g2 == 0)).all() and (by["dropped"].g1 == 0).sum() == 16
    assert fusion.variant_rows(df, ["c1"], ["g1"], False).groupBy("variant").count().where("count <> 16").count() == 0


def test_single_blocks_equal_their_own_forest(spark, fused):
    df, got = fused
    train, test = df.where("split = 'train' and task = 'r'"), df.where("split = 'test' and task = 'r'")
    alone = trees.extra_trees(train.withColumn("g1", F.lit(0.0)).withColumn("g2", F.lit(0.0)), KEYS, ["c1", "g1", "g2"], "y", trees=15, depth=6)
    want = alone.predict(test.withColumn("g1", F.lit(0.0)).withColumn("g2", F.lit(0.0))).toPandas().set_index("mol_id").pred
    mine = got[got.task == "r"].set_index("mol_id").p_cheap
    assert np.allclose(mine.sort_index(), want.sort_index())


def test_methods_follow_from_their_parts(fused):
    _, got = fused
    assert len(got) == 120 and not got.duplicated(["task", "mol_id"]).any()
    for task, g in got.groupby("task"):
        bound = (lambda p: p.clip(1e-6, 1 - 1e-6)) if task == "c" else (lambda p: p)
        assert np.allclose(g.late_mean, bound((g.p_cheap + g.p_costly) / 2))
        for name, other in (("late_weighted", g.p_costly), ("early_weighted", g.p_early)):
            assert any(np.allclose(g[name], bound(g.p_cheap * (1 - k / 20) + other * k / 20)) for k in range(21))
        assert np.allclose(g.gated, bound(np.where(g.called, g.p_early, g.p_cheap)))
        error = lambda c, g=g: np.abs(g.y - g[c]).mean()
        assert error("p_early") < error("p_cheap") and error("stacked") < error("p_cheap") and 0 < g.called.mean() <= 1


def test_metrics_of_all_methods(spark, fused):
    _, got = fused
    out = fusion.fusion_metrics(spark.createDataFrame(got), KEYS).toPandas()
    assert len(out) == 18 and set(out.method) == set(fusion.METHODS.values())
    reg = out[out.task == "r"].set_index("method")
    mine = got[got.task == "r"]
    for column, method in fusion.METHODS.items():
        assert math.isclose(reg.MAE[method], np.abs(mine.y - mine[column]).mean()) and math.isnan(reg.AUROC[method])
    assert math.isclose(reg.call_rate["gated_val_utility_fusion"], 100 * mine.called.mean()) and reg.call_rate.notna().sum() == 1


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_mixture_against_a_loop(spark, kind):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 80).astype(float) if kind == "classification" else rng.normal(size=80)
    preds = {"good": np.clip(0.1 + 0.8 * y, 0, 1) if kind == "classification" else y + 0.1 * rng.normal(size=80), "bad": rng.random(80), "other": rng.random(80)}
    rows = [("t", kind, i, float(y[i]), m, float(p[i])) for m, p in preds.items() for i in range(80)]
    df = spark.createDataFrame(rows, "task string, task_type string, mol_id long, y double, member string, pred double")
    got = {r.member: (r.weight, r.deviation) for r in fusion.mixture_weights(df, ["task", "task_type"], rounds=4).collect()}
    p = np.stack(list(preds.values()), 1)
    weight, deviation = np.full(3, 1 / 3), np.sqrt(((y[:, None] - p) ** 2).mean(0))
    for _ in range(4):
        if kind == "classification":
            q = np.clip(p, 1e-6, 1 - 1e-6)
            like = np.where(y[:, None] == 1, q, 1 - q)
        else:
            like = np.exp(-((y[:, None] - p) ** 2) / (2 * deviation**2)) / deviation
        r = weight * like
        r /= r.sum(1, keepdims=True)
        weight, deviation = r.mean(0), np.sqrt((r * (y[:, None] - p) ** 2).sum(0) / r.sum(0))
    assert np.allclose([got[m] for m in preds], np.stack([weight, deviation], 1)) and got["good"][0] > 0.5


def gains(n=120):
    rng = random.Random(2)
    out = []
    for task, scale in (("wide", 1.0), ("none", 0.0), ("up", 0.0)):
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            u = scale * (a + 0.2 * rng.gauss(0, 1)) + (1.0 if task == "up" else 0.0)
            out.append((task, i, i % 3, u, a, b))
    return out


def test_targets_against_their_definitions(spark):
    rows = gains()
    df = spark.createDataFrame(rows, "task string, mol_id long, fold int, utility double, a double, b double")
    got = routers.targets(df, ["task"], "utility").toPandas().sort_values(["task", "mol_id"])
    for task, g in got.groupby("task"):
        u = np.array([r[3] for r in rows if r[0] == task])
        m = max(1e-12, 0.25 * u.std())
        assert np.allclose(g.margin, m) and np.allclose(g.t0, u) and (g.t1 == (u > 0)).all()
        assert np.allclose(g.t5, pd.Series(u).rank(pct=True)) and (g.t3 == np.where(u > m, 1, np.where(u < -m, -1, 0))).all()
        assert (g.t2.isna() == (np.abs(u) <= m)).all() and (g.t2.dropna() == (u > m)[np.abs(u) > m]).all()


def test_objectives_rank_gains_and_folds_do_not_leak(spark):
    rows = gains()
    df = spark.createDataFrame(rows, "task string, mol_id long, fold int, utility double, a double, b double").repartition(3)
    got = routers.out_of_fold_scores(df, ["task"], "fold", 3, ["a", "b"], trees=10, depth=5).toPandas()
    assert len(got) == len(rows)
    wide = got[got.task == "wide"]
    for name in routers.OBJECTIVES:
        assert wide[name].rank().corr(wide.utility.rank()) > 0.7, name
    same = got[got.task == "up"]
    assert (same.R1_binary == 1).all() and (same.R2_margin_binary == 0).all() and (same.R3_three_class == 0).all() and (same.R4_pairwise_margin_weighted == 0).all()
    # a fold's scores are those of a fit on the other folds
    train, asked = df.where("fold <> 1"), df.where("fold = 1")
    alone = routers.objective_scores(train, asked, ["task"], ["a", "b"], trees=10, depth=5).toPandas().set_index(["task", "mol_id"]).sort_index()
    mine = got[got.fold == 1].set_index(["task", "mol_id"]).sort_index()
    for name in routers.OBJECTIVES:
        assert np.allclose(alone[name].astype(float), mine[name].astype(float), atol=1e-6), name


def test_pairs_of_all_folds_from_one_order(spark, monkeypatch):
    """The pairs of each training set are those that `pairwise_rows` draws from its rows alone, whatever the blocks."""
    monkeypatch.setattr(routers, "BLOCK", 16)
    monkeypatch.setattr(routers, "APART", 23)
    rows = gains()
    df = spark.createDataFrame(rows, "task string, mol_id long, fold int, utility double, a double, b double").repartition(3)
    t = routers.fold_targets(df, ["task"], "fold", 3, "utility")
    names = sorted({r[0] for r in rows})
    sizes = np.array([[sum(r[0] == n and r[2] != k for r in rows) for k in range(3)] for n in names])
    margins = np.array([t.where(F.col("task") == n).first()._margin for n in names])
    numbered = t.withColumn("_g", F.array_position(F.array(*map(F.lit, names)), F.col("task")).cast("int") - 1)
    got = routers.fold_pairs(numbered, "fold", sizes, margins, "utility", ["a", "b"], partners=3, seed=4).toPandas()
    for g, name in enumerate(names):
        for k in range(3):
            mine = [(r[0], r[1], r[3], r[4], r[5]) for r in rows if r[0] == name and r[2] != k]
            place = {r[1]: i for i, r in enumerate(sorted(mine, key=lambda r: (int(hashlib.md5(f"4:{r[1]}".encode()).hexdigest()[:8], 16), r[1])))}
            order = sorted(mine, key=lambda r: place[r[1]])
            want = []
            for i, r in enumerate(order):
                for turn in (1, 2, 3):
                    o = order[(i + turn * 23) % len(order)]
                    if abs(r[2] - o[2]) > margins[g][k]:
                        want.append((r[3] - o[3], r[4] - o[4], float(r[2] > o[2]), abs(r[2] - o[2])))
            runs = got[got._g == g * 3 + k]
            found = [(*x, y, w) for r in runs.itertuples() for x, y, w in zip(np.reshape(r._2, (-1, 2)), r._3, r._4, strict=True)]
            assert np.allclose(sorted(found), sorted(want)) if want else not found


def test_a_row_trains_many_folds_but_is_stored_once(spark, monkeypatch):
    rows = gains()
    df = spark.createDataFrame(rows, "task string, mol_id long, fold int, utility double, a double, b double").repartition(3)
    kept = {}
    written = routers.written
    monkeypatch.setattr(routers, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    routers.out_of_fold_scores(df, ["task"], "fold", 3, ["a", "b"], trees=2, depth=2)
    assert kept["targets"].count() == len(rows)
