"""Tests, resampling, splits and selection against plain loops over the stated rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import inference, metrics, relational, routing, selection, splits


def rows_of(spark, y, a, b, kind="regression", task="T"):
    data = [(task, kind, 0, i, float(y[i]), float(a[i]), float(b[i])) for i in range(len(y))]
    return spark.createDataFrame(data, "task string, task_type string, seed int, mol_id long, y double, pred2d double, pred3d double")


def test_thin_evidence_denies(spark):
    one = rows_of(spark, [1], [3], [1])
    r = inference.paired_t(one, ["task"], F.col("pred2d") - F.col("pred3d")).first()
    assert (r.p, r.lower, r.permission) == (1.0, None, False) and r.gain == 2
    thin = rows_of(spark, [1, 0, 0, 0], [0.2, 0.1, 0.3, 0.4], [0.9, 0.1, 0.2, 0.3], "classification")
    r = inference.paired_delong(thin, ["task"]).first()
    assert (r.p, r.lower, r.permission) == (1.0, None, False) and r.gain == pytest.approx(2 / 3)
    sure = rows_of(spark, [0] * 20, [2] * 20, [1] * 20)
    r = inference.paired_t(sure, ["task"], F.col("pred2d") - F.col("pred3d")).first()
    assert (r.p, r.lower, r.permission) == (0.0, 1.0, True)


def test_lower_bound_is_where_the_test_turns(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(0.3, 1, 12)
    r = inference.paired_t(rows_of(spark, [0] * 12, d, [0] * 12), ["task"], F.col("pred2d")).first()
    se = d.std(ddof=1) / math.sqrt(12)
    assert r.lower == pytest.approx(d.mean() - 2.200985160082949 * se, abs=1e-9)


def test_zero_gain_is_a_false_activation(spark):
    s = spark.createDataFrame([("p", True, 0.0), ("p", True, -1.0), ("p", False, 2.0), ("p", True, 3.0)], "policy string, permission boolean, gain double")
    assert metrics.risk_benefit(s, ["policy"]).first().false_activation == 0.5
    out = [(r.false_activation, r.false_rejection, r.negative_transfer, r.missed_gain, r.regret) for r in routing.policy_outcomes(s, "gain").collect()]
    assert out == [(True, False, 0, 0, 0), (True, False, 1, 0, 1), (False, True, 0, 2, 2), (False, False, 0, 0, 0)]


def test_balanced_parts_follow_the_rule():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 40)
    positives = np.array([rng.integers(0, s + 1) for s in sizes])
    got = splits.balanced_parts(sizes, positives, 11)
    n, pos = int(sizes.sum()), int(positives.sum())
    goal = lambda k: dict(zip(("train", "val", "test"), (max(1, round(0.8 * k)), max(1, round(0.1 * k)), max(1, k - round(0.8 * k) - round(0.1 * k))), strict=True))
    goals, order = (goal(n), goal(pos), goal(n - pos)), list(range(40))
    np.random.default_rng(11).shuffle(order)
    order.sort(key=lambda g: (-sizes[g], -positives[g]))
    have, want = {p: [0, 0, 0] for p in goals[0]}, {}
    for g in order:
        scores = {}
        for part, held in have.items():
            after = [h + v for h, v in zip(held, (sizes[g], positives[g], sizes[g] - positives[g]), strict=True)]
            gaps = [abs(x - t[part]) / t[part] for x, t in zip(after, goals, strict=True)]
            scores[part] = 1.5 * max(0, after[0] - goals[0][part]) / goals[0][part] + gaps[0] + 0.75 * gaps[1] + 0.75 * gaps[2]
        want[g] = min(scores, key=scores.get)
        have[want[g]] = [h + v for h, v in zip(have[want[g]], (sizes[g], positives[g], sizes[g] - positives[g]), strict=True)]
    assert got == [want[g] for g in range(40)]


def test_stratified_parts_follow_the_rule():
    table = np.random.default_rng(4).integers(0, 9, (30, 3)).astype(float)
    got = splits.stratified_parts(table, 5)
    rng, order, n = np.random.default_rng(5), list(range(30)), int(table.sum())
    rng.shuffle(order)
    target = {"train": round(0.8 * n), "val": round(0.1 * n)}
    target["test"] = n - target["train"] - target["val"]
    held, want = {p: np.zeros(3) for p in target}, {}
    for g in order:
        scored = []
        for part in target:
            fill = (held[part].sum() + table[g].sum()) / target[part]
            label = np.mean((held[part] + table[g]) / np.maximum(table.sum(0) * target[part] / n, 1))
            scored.append((fill + 0.35 * label + 100 * max(0.0, fill - 1) + rng.uniform(0, 1e-9), part))
        want[g] = min(scored)[1]
        held[want[g]] += table[g]
    assert got == [want[g] for g in range(30)]


def test_hierarchical_interval_against_a_loop(spark):
    rng, groups, parts = np.random.default_rng(8), [], []
    for i, kind in enumerate(("regression", "classification", "regression")):
        n = 12 + i
        y = rng.integers(0, 2, n).astype(float)
        y[:2] = 0, 1
        groups.append((y, rng.random(n), rng.random(n), kind == "classification"))
        parts.append(rows_of(spark, *groups[-1][:3], kind, f"T{i}").withColumn("c", F.lit("all")))
    r = inference.hierarchical_interval(relational.union_all(parts), ["c"], ["task"], 60, 2).first()

    def gain(y, a, b, cls):
        if not cls:
            return np.abs(y - a).mean() - np.abs(y - b).mean()
        auc = lambda p: np.mean([(u > d) + 0.5 * (u == d) for u in p[y == 1] for d in p[y == 0]])
        return auc(b) - auc(a) if 0 < y.sum() < len(y) else math.nan

    means = []
    for turn in range(60):
        picked = np.random.default_rng([2, turn]).integers(0, 3, 3)
        drawn = []
        for slot, g in enumerate(picked):
            y, a, b, cls = groups[g]
            at = np.random.default_rng([2, turn, slot]).integers(0, len(y), len(y))
            drawn.append(gain(y[at], a[at], b[at], cls))
        means.append(np.nanmean(drawn))
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert r.mean == pytest.approx(np.mean([gain(*g) for g in groups]))


def test_random_budget_and_permutation_null(spark):
    rng = np.random.default_rng(1)
    y, a, b = rng.random(20), rng.random(20), rng.random(20)
    df = rows_of(spark, y, a, b)
    r, gen, want = inference.random_budget_gain(df, ["task"], 22, 30, 6).first(), np.random.default_rng(6), []
    for _ in range(30):
        at, p = gen.choice(20, 5, replace=False), a.copy()
        p[at] = b[at]
        want.append(np.abs(y - a).mean() - np.abs(y - p).mean())
    assert (r.called, r.mean, r.sd) == pytest.approx((5, np.mean(want), np.std(want, ddof=1)))
    none = inference.permutation_null(df.withColumn("s", F.lit(False)), ["task"], "s", "y").first()
    assert (none.n_selected, none.permit_rate) == (0, None)
    every = inference.permutation_null(df.withColumn("s", F.lit(True)), ["task"], "s", "y", 5).first()
    assert every.n_selected == 20 and every.permit_rate == 1 and 0 < every.mean_bound < y.mean()
    assert inference.mean_lcb(np.zeros(0), 0.025, gen, 9) == -math.inf and inference.mean_lcb(np.array([3.0, np.nan]), 0.025, gen, 9) == 3


def test_cluster_ratios_and_lone_groups(spark):
    s = spark.createDataFrame([("p", i, float(i % 3), 0.0) for i in range(6)], "policy string, seed int, gain double, zero double")
    r = {x.value_name: x for x in inference.cluster_intervals(s, ["policy"], "seed", ["gain"], 200, ratios={"q": ("gain", "zero"), "one": ("gain", "gain")}).collect()}
    assert r["q"].mean is None and r["q"].low is None and (r["one"].mean, r["one"].low, r["one"].high) == (1, 1, 1) and r["gain"].mean == 1


def test_fold_scores_need_enough(spark):
    rows = [("a", i, i % 4, float(i)) for i in range(40)] + [("b", i, 0, float(i)) for i in range(40)] + [("c", i, i % 2, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "task string, mol_id long, fold int, s double").withColumn("s", F.when((F.col("mol_id") % 8 != 3), F.col("s")))
    got = selection.fold_scores(df, ["task"], "fold", "s").collect()
    assert {r.task for r in got} == {"a"} and len(got) == 40
    known = [float(i) for i in range(40) if i % 8 != 3]
    assert all(r.s == (np.median(known) if r.mol_id % 8 == 3 else r.mol_id) for r in got)


def test_lexicographic_best_and_first_known(spark):
    df = spark.createDataFrame([("t", 1.0, 0.5, 0), ("t", 1.0, 0.7, 1), ("t", 1.0, 0.7, 2), ("t", None, 9.0, 3), ("u", None, None, 4)], "task string, a double, b double, place int")
    assert {r.task: r.place for r in selection.lexicographic_best(df, ["task"], "a", "b", ["place"]).collect()} == {"t": 1, "u": 4}
    df = spark.createDataFrame([("k", 1, None, "x"), ("k", 2, 5.0, None), ("k", 3, 6.0, "y")], "k string, o int, v double, w string")
    assert tuple(relational.first_known(df, ["k"], ["o"]).select("v", "w").first()) == (5.0, "x")


def test_calibration_falls_back_on_every_fifth_row(spark):
    df = spark.createDataFrame([("t", 7, i, i % 5) for i in range(100)] + [("u", 7, i, i % 5) for i in range(20)], "task string, seed int, mol_id long, fold int")
    got = {(r.task, r.mol_id): r.part for r in selection.calibration_part(df, ["task"], "fold", "seed").collect()}
    assert all(got["t", i] == ("cal" if i % 5 == 2 else "train") for i in range(100))
    assert all(got["u", i] == ("cal" if i % 5 == 0 else "train") for i in range(20))


def test_calibration_orders_only_groups_that_lack_rows(spark, monkeypatch):
    df = spark.createDataFrame([("t", 7, i, i % 5) for i in range(100)] + [("u", 7, i, i % 5) for i in range(20)], "task string, seed int, mol_id long, fold int")
    ordered, plain = [], selection.running
    monkeypatch.setattr(selection, "running", lambda rows, *rest, **more: ordered.append(rows.count()) or plain(rows, *rest, **more))
    assert selection.calibration_part(df, ["task"], "fold", "seed").count() == 120
    assert ordered == [20]


def test_gates_of_a_group_share_its_order(spark, monkeypatch):
    """All gates of a group in one call give what each gives alone, and rows are put in order once."""
    rows = [(k, t, i, float((i * 7) % 5 > 1) if t == "classification" else i % 3 + 0.5, i * 0.1 % 0.7, i * 0.3 % 0.9, i * 11 % 23 / 23) for k, t in (("a", "classification"), ("b", "regression")) for i in range(40)]
    df = spark.createDataFrame(rows, "task string, task_type string, mol_id long, y double, pred2d double, pred3d double, s double")
    kinds = ["task", "task_type"]
    gates = spark.createDataFrame([(k, t, g, x) for k, t in (("a", "classification"), ("b", "regression")) for g, x in ((0, None), (1, 0.6))], "task string, task_type string, gate int, threshold double")
    ordered, plain = [], selection.positions
    monkeypatch.setattr(selection, "positions", lambda rows, *rest, **more: ordered.append(rows.count()) or plain(rows, *rest, **more))
    both = {(r.task, r.gate, r.budget): (r.call_rate, r.performance) for r in selection.gated_performance(df, kinds, "s", "threshold", (0, 20, 100), gates=gates).collect()}
    assert ordered == [80] and len(both) == 12
    for gate in (0, 1):
        for r in selection.gated_performance(df.join(gates.where(f"gate = {gate}"), kinds), kinds, "s", "threshold", (0, 20, 100)).collect():
            assert both[r.task, gate, r.budget] == pytest.approx((r.call_rate, r.performance))


def test_a_budget_adds_to_the_sums_of_the_one_before(spark):
    """Every budget's error and call rate against a loop; the rows are summed once, not once for each budget. A missing score has no call rate where it is reached."""
    rows = [("a", "regression", i, i % 3 + 0.5, i * 0.1 % 0.7, i * 0.3 % 0.9, None if i in (4, 9) else i * 11 % 23 / 23) for i in range(30)]
    df = spark.createDataFrame(rows, "task string, task_type string, mol_id long, y double, pred2d double, pred3d double, s double")
    got = selection.gated_performance(df.withColumn("gate", F.lit(0.4)), ["task", "task_type"], "s", "gate", (100, 0, 20, 97))
    assert "_reach" in got._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(rows, key=lambda r: (r[6] is None, -(r[6] or 0), r[2]))
    for r in got.collect():
        n = round(30 * r.budget / 100)
        on = [None if x[6] is None and i < n else i < n and x[6] >= 0.4 for i, x in enumerate(order)]
        known = [o for o in on if o is not None]
        assert r.call_rate == pytest.approx(sum(known) / len(known))
        assert r.performance == pytest.approx(-sum(abs(x[3] - (x[5] if o else x[4])) for x, o in zip(order, on, strict=True)) / 30)


def test_gains_shared_by_many_scores_are_ordered_once(spark):
    rows = [("a", c, i, (i * 7 % 11) / 11 - 0.2, (i * k) % 13 / 13) for c, k in (("p", 3), ("q", 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "task string, c string, mol_id long, u double, s double")
    want = metrics.ndcg(df, ["task", "c"], "s", "u", 20).orderBy("c").collect()
    got = metrics.ndcg(df, ["task", "c"], "s", "u", 20, (df.where("c = 'p'"), ["task"])).orderBy("c").collect()
    assert [r.c for r in got] == ["p", "q"] and [r.ndcg for r in got] == pytest.approx([r.ndcg for r in want])
    both = selection.fold_scores(df.withColumn("fold", F.col("mol_id") % 4), ["task", "c"], "fold", "s", least=4, median="half")
    for r in both.groupBy("task", "c").agg(F.first("half").alias("half"), F.percentile("s", F.lit(0.5)).alias("whole")).collect():
        assert r.half == r.whole
