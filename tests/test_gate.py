"""The gate against its definitions on a small table."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import gate, trees

KEYS = ["task", "task_type", "seed"]
COLUMNS = "task string, task_type string, seed int, mol_id long, group_key long, split string, y double, c1 double, g1 double, g2 double"


def table(n=200):
    rng = random.Random(8)
    out = []
    for task, kind in (("c", "classification"), ("r", "regression")):
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            y = a + 2 * b if kind == "regression" else float(a + 2 * b > 0)
            out.append((task, kind, 0, i, i // 3, ("train", "train", "val", "test")[i % 4], y, a, b, rng.random()))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(table(), COLUMNS).repartition(3)


def test_conditions(df):
    rows = gate.with_conditions(df, KEYS, ["g1", "g2"]).toPandas()
    by = {c: g.set_index(["task", "mol_id"]).sort_index() for c, g in rows.groupby("condition")}
    true, none, moved = by["original_true3d"], by["seed_null_2d"], by["permuted_3d_placebo"]
    assert (none[["g1", "g2"]] == 0).all(axis=None) and (moved.c1 == true.c1).all()
    pairs = lambda g, split, task: Counter(map(tuple, g[g.split == split].loc[task][["g1", "g2"]].to_numpy().tolist()))
    for split in ("train", "val", "test"):
        for task in "cr":
            assert pairs(true, split, task) == pairs(moved, split, task)
    assert (moved.g1 != true.g1).mean() > 0.9


def test_folds_within_their_bounds(spark, df):
    few = [("few", "classification", 0, i, i, "train", float(i < 3), 0.0, 0.0, 0.0) for i in range(30)]
    one = [("one", "classification", 0, i, i, "train", 1.0, 0.0, 0.0, 0.0) for i in range(9)] + [("lone", "regression", 0, i, 7, "train", 1.0, 0.0, 0.0, 0.0) for i in range(9)]
    rows = gate.usable_folds(df.where("split = 'train'").unionByName(spark.createDataFrame(few + one, COLUMNS)), KEYS, "group_key", 5).toPandas()
    assert rows[rows.task.isin(["one", "lone"])].fold.isna().all() and set(rows[rows.task == "few"].fold) == {0, 1, 2}
    for task in "cr":
        mine = rows[rows.task == task]
        assert set(mine.fold) == set(range(5)) and (mine.groupby("group_key").fold.nunique() == 1).all()


def test_predictions_do_not_see_their_fold(spark, df):
    train = gate.usable_folds(df.where("split = 'train'"), KEYS, "group_key", 3)
    rest = df.where("split <> 'train'").withColumn("fold", F.lit(None).cast("int"))
    both = train.unionByName(rest).cache()
    got = gate.both_predictions(both, KEYS, ["c1"], ["g1", "g2"], trees=6, depth=4).toPandas()
    assert len(got) == 3 * both.count() and got.ref.notna().all() and got.alt.notna().all()
    plain = both.where("task = 'r'")
    ref = trees.extra_trees(plain.where("split = 'train' and fold <> 1"), KEYS, ["c1"], "y", trees=6, depth=4)
    alt = trees.extra_trees(plain.where("split = 'train'"), KEYS, ["c1", "g1", "g2"], "y", trees=6, depth=4, seed=1000)
    mine = got[(got.task == "r") & (got.condition == "original_true3d")].set_index("mol_id").sort_index()
    want = ref.predict(plain.where("fold = 1"), "p").toPandas().set_index("mol_id").p.sort_index()
    assert np.allclose(mine[mine.fold == 1].ref, want)
    want = alt.predict(plain.where("split = 'test'"), "p").toPandas().set_index("mol_id").p.sort_index()
    assert np.allclose(mine[mine.split == "test"].alt, want)


def test_policies_and_controls(df):
    out = gate.gate(df, KEYS, ["c1"], ["g1", "g2"], "group_key", folds=2, repeats=4, trees=10, depth=4).toPandas()
    assert len(out) == 2 * 3 * (7 + 8)
    per = out.set_index(["task", "condition", "policy", "repeat"])
    for task in "cr":
        for c in gate.CONDITIONS:
            at = lambda p, c=c, task=task: per.loc[task, c, p, 0]
            assert at("2D_reference").gain == 0 and at("2D_reference").n_selected == 0 and at("100%_alternative").call_rate == 100
            assert at("Oracle@20").n_selected == 10 and at("Oracle@20").mean_utility >= at("R9_HoldoutLCB").mean_utility and at("Oracle@20").captured > 0.2
            random_ = out[(out.task == task) & (out.condition == c) & (out.policy == "Random@20")]
            assert (random_.n_selected == 10).all() and random_.mean_utility.nunique() > 1
            matched = out[(out.task == task) & (out.condition == c) & (out.policy == "Random_call_matched_R9")]
            assert (matched.n_selected == at("R9_HoldoutLCB").n_selected).all() and len(matched) == 4
        true, none = (per.loc[task, c, "100%_alternative", 0].gain for c in ("original_true3d", "seed_null_2d"))
        assert true > 0.05 and true > none
    assert per.loc["r", "original_true3d", "TaskLCB", 0].n_selected == 50
