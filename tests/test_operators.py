"""Small cases with known answers."""

import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import ensembles, features, inference, metrics, models, ordered, relational, routing, splits
from tandem.sources import tables
from tandem.streaming import monitor


def one(df):
    return df.first()


def paired(spark, y, a, b, kind="regression", seed=0):
    rows = [("T", kind, seed, i, float(p), float(q), float(s)) for i, (p, q, s) in enumerate(zip(y, a, b, strict=True))]
    return spark.createDataFrame(rows, "task string, task_type string, seed int, mol_id long, y double, pred2d double, pred3d double")


def test_budget_selection(spark):
    df = spark.createDataFrame([("T", i, s) for i, s in enumerate([0.1, 0.8, 0.2, 0.7, 0.4])], "task string, mol_id long, score double")
    pick = lambda t: [r.selected for r in t.orderBy("mol_id").collect()]
    assert pick(routing.top_budget(df, ["task"], "score", 40)) == [False, True, False, True, False]
    assert not any(pick(routing.top_budget(df, ["task"], "score", 0)))
    assert all(pick(routing.top_budget(df, ["task"], "score", 100)))
    assert sum(pick(routing.top_budget(df, ["task"], "score", 50))) == 2  # 2.5 to even
    assert sum(pick(routing.top_share(df, ["task"], "score", 41))) == 3
    assert sum(pick(routing.top_count(df, ["task"], "score", 4))) == 4
    assert sum(pick(routing.top_positive(df, ["task"], "score", 100, 0.3))) == 3
    gate = spark.createDataFrame([("other", 0.0)], "task string, threshold double")
    assert not any(pick(routing.top_gated(df, gate, ["task"], "score", 100)))


def test_utilities_and_uncertainty(spark):
    reg = routing.with_utilities(paired(spark, [0, 1], [1, 3], [0.25, 2])).orderBy("mol_id")
    assert [r.utility for r in reg.collect()] == [0.75, 1.0]
    cls = paired(spark, [0, 1, 1], [0, 0.5, 1], [0, 0, 0], "classification")
    assert [r.uncertainty for r in routing.uncertainty(cls, ["task"], cls).orderBy("mol_id").collect()] == [0, 0.5, 0]
    ref, test = paired(spark, [0] * 3, [0, 1, 2], [0] * 3), paired(spark, [0] * 2, [10, 11], [0] * 2)
    got = [r.uncertainty for r in routing.uncertainty(test, ["task"], ref).orderBy("mol_id").collect()]
    assert got == pytest.approx([9 / math.sqrt(2 / 3), 10 / math.sqrt(2 / 3)])


def test_running_sums_nulls_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), None if rng.random() < 0.1 else float(rng.integers(-5, 6)), i) for i, g in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "g int, x double, i long")
    for down in (False, True):
        got = {r.i: r.n for r in ordered.running(df, ["g"], "x", {"n": F.lit(1).cast("long")}, down, ["i"], stretches=4).collect()}
        for g in range(3):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[2]))
            assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    flat = spark.createDataFrame([(1, math.inf), (1, 2.0), (1, -math.inf)], "g int, x double")
    assert sorted(r.n for r in ordered.running(flat.where("x = 2"), ["g"], "x", {"n": F.lit(1).cast("long")}).collect()) == [1]


def test_metrics_on_degenerate_groups(spark):
    cls = paired(spark, [1, 1], [0.2, 0.9], [0.1, 0.1], "classification")
    assert one(metrics.auroc(cls, ["task"], "y", "pred2d")).AUROC is None
    assert one(metrics.average_precision(cls, ["task"], "y", "pred2d")).AUPRC == 1.0
    assert one(metrics.errors(paired(spark, [2, 2], [2, 2], [0, 0]), ["task"], "y", "pred2d")).R2 == 1.0
    assert one(metrics.errors(paired(spark, [2, 2], [2, 3], [0, 0]), ["task"], "y", "pred2d")).R2 == 0.0
    assert one(metrics.ndcg(routing.with_utilities(paired(spark, [0, 0], [1, 1], [2, 2])), ["task"], "pred2d", "utility", 20)).ndcg is None
    ties = paired(spark, [0, 1, 0, 1], [0.5] * 4, [0] * 4, "classification")
    assert one(metrics.auroc(ties, ["task"], "y", "pred2d")).AUROC == 0.5


def test_risk_benefit_undefined_without_mass(spark):
    states = spark.createDataFrame([("p", False, 0.5), ("p", False, 0.2)], "policy string, permission boolean, gain double")
    r = one(metrics.risk_benefit(states, ["policy"]))
    assert r.gain_retention == 0 and r.harm_avoidance is None and r.false_rejection == 1
    never = spark.createDataFrame([("p", False, 0.5), ("p", False, -0.2)], "policy string, permission boolean, gain double")
    r = one(metrics.risk_benefit(never, ["policy"]))
    assert (r.gain_retention, r.harm_avoidance, r.activation) == (0, 1, 0)


def test_bootstrap_against_loop():
    rng = np.random.default_rng(5)
    y, a, b = np.array([0, 1, 0, 1, 1, 0, 1.0]), rng.random(7), rng.random(7)
    got = inference.bootstrap_gains(y, a, b, True, 99, 33)
    rng, want = np.random.default_rng(33), []
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(99):  # the protocol draws positions of positives, then of negatives, for each resample
        ps, ns = up[rng.choice(4, 4, replace=True)], down[rng.choice(3, 3, replace=True)]
        auc = lambda p: np.mean([[(p[j] > p[k]) + 0.5 * (p[j] == p[k]) for k in ns] for j in ps])
        want.append(auc(b) - auc(a))
    assert got == pytest.approx(want)
    assert np.isnan(inference.bootstrap_gains(np.ones(3), a[:3], b[:3], True, 5, 0)).all()
    old, new = np.abs(y - a), np.abs(y - b)
    at = np.random.default_rng(7).integers(0, 7, size=(200, 7))
    assert inference.bootstrap_gains(y, a, b, False, 200, 7) == pytest.approx(old[at].mean(1) - new[at].mean(1))
    swapped = inference.bootstrap_gains(y, b, a, True, 99, 33)
    assert got == pytest.approx(-swapped)


def test_permission_needs_evidence(spark):
    same = paired(spark, range(20), range(20), range(20))
    assert one(inference.exact_lcb(same, ["task"], 50)).lcb == 0
    better = paired(spark, range(20), [i + 2 for i in range(20)], [i + 1 for i in range(20)])
    assert one(inference.exact_lcb(better, ["task"], 50)).lcb == 1
    assert one(inference.hashed_lcb(routing.with_utilities(better), ["task"], "utility", "mol_id", 20)).lcb == 1
    few = routing.with_utilities(paired(spark, range(5), [i + 2 for i in range(5)], range(5)))
    assert one(inference.hashed_lcb(few, ["task"], "utility", "mol_id", 20)).lcb is None
    rule = inference.permitted(F.lit(0.01), F.lit(None).cast("double"))
    assert one(spark.range(1).select(rule.alias("p"))).p is False


def test_tests_p_values(spark):
    # P(T > t) from tables: t = 2.015 at 5, 1.812 at 10 and 1.645 at 10^6 degrees of freedom leave one twentieth
    for t, df in ((2.01505, 5), (1.81246, 10), (1.64486, 1_000_000)):
        assert inference._t_tail(t, df) == pytest.approx(0.05, abs=1e-5)
        assert inference._t_tail(-t, df) == pytest.approx(0.95, abs=1e-5)
    assert inference._t_tail(0.0, 3) == pytest.approx(0.5)
    assert inference._t_tail(1.0, 1) == pytest.approx(0.25)
    d = paired(spark, [0] * 6, [1, 2, 3, 4, 5, 6], [0] * 6)
    r = one(inference.paired_t(d, ["task"], F.col("pred2d")))
    assert r.t == pytest.approx(3.5 / (np.std([1, 2, 3, 4, 5, 6], ddof=1) / math.sqrt(6))) and 0 < r.p < 0.01
    flat = one(inference.paired_t(d, ["task"], F.lit(0.0)))
    assert flat.p == 1.0
    y = [0, 1, 0, 1, 1, 0, 1, 0]
    shift = paired(spark, y, [0.1 * i for i in range(8)], [0.1 * i + 1 for i in range(8)], "classification")
    r = one(inference.paired_delong(shift, ["task"]))
    assert r.gain == 0 and r.p == 1.0


def test_splits_are_disjoint_and_seeded(spark):
    rows = [("T", i, f"g{i % 17}", float(i % 2), 3 + i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "task string, mol_id long, group_key string, y double, stratum int")
    for mode, more in (("greedy", {}), ("balanced", {"positive": F.col("y") > 0}), ("stratified", {"strata": "stratum"})):
        s = splits.group_split(df, ["task"], "group_key", mode, seed=1, **more)
        assert s.count() == 200 and splits.leaking_groups(s, ["task"], "group_key").count() == 0
        sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
        assert 120 <= sizes["train"] <= 180
    a, b = (splits.random_split(df, ["task"], k).select("mol_id", "split").collect() for k in (1, 2))
    assert sorted(a) != sorted(b)
    assert splits.subsample(df, ["task"], 30, 5).count() == 30
    assert splits.label_fraction(df, ["task"], "y", 0.999, 1).count() == 200
    f = splits.group_folds(df, ["task"], "group_key", 4)
    assert f.groupBy("group_key").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_bins_and_scalars(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (99.5,), (None,)], "x double")
    got = [r[0] for r in df.select(S.bin_right_closed("x", (-0.1, 0, 2, 5, 8, 99))).collect()]
    assert got == [0, 1, 2, None, None]
    r = one(spark.range(1).select(S.half_even(F.lit(2.5)), S.half_even(F.lit(3.5)), S.ratio(F.lit(1), F.lit(0)), S.clipped(F.lit(None).cast("double")), S.no_nan(F.lit(math.nan))))
    assert tuple(r) == (2, 4, None, None, None)
    c = one(spark.range(1).select(S.gain_category(F.lit("MAE"), F.lit(1.0), F.lit(0.97)), S.gain_category(F.lit("AUROC"), F.lit(0.5), F.lit(0.48)), S.mean_and_spread(F.lit(1.0), F.lit(0.5))))
    assert tuple(c) == ("helpful", "harmful", "1.000000 +/- 0.500000")


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, None), (None, 4, 1.0)], "k string, i int, v double")
    assert [r.i for r in relational.arg_best(df, ["k"], F.col("v"), ["i"]).orderBy("i").collect()] == [1, 4]
    assert sorted(r.i for r in relational.first_by(df, ["k"], ["i"], last=True).collect()) == [2, 3, 4]
    assert relational.summarise(df, ["k"], ["v"], count="i").count() == 2
    assert relational.summarise(df, ["k"], ["v"], count="i", keep_null_keys=True, text=True).count() == 3
    with pytest.raises(ValueError):
        relational.join_one_to_one([df, df], ["k"])
    with pytest.raises(KeyError):
        relational.lookup(df, df.where("i = 1"), ["k"])
    assert relational.same_rows(df, df) and not relational.same_rows(df, df.limit(2))
    assert [r.k for r in relational.ordered_by_map(df.where("v is not null"), "k", {"a": 2}, "i").collect()][-1] is None
    assert relational.pivot_count(df, ["v"], "k", ["a", "z"]).where("z > 0").count() == 0


def test_greedy_ensemble_readds_the_best():
    y = np.array([0.0, 1, 2, 3])
    preds = np.stack([y, y + 1], axis=1)
    assert ensembles.greedy_choice(y, preds, False, 5).tolist() == [5, 0]
    assert ensembles.greedy_choice(y, preds, False, 5, readd=False).tolist() == [1, 0]
    assert ensembles.greedy_choice(y, np.stack([y - 1, y + 1], axis=1), False, 2).tolist() == [1, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,s\n1.5,a\nnan,b\n")
    (tmp_path / "b.csv").write_text("x,s\n,c\n")
    got = tables.read_csv(spark, f"file://{tmp_path}/*.csv", "x double, s string")
    assert sorted((str(r.x), r.s) for r in got.collect()) == [("1.5", "a"), ("None", "b"), ("None", "c")]
    assert tables.read_or_empty(spark, f"file://{tmp_path}/none.csv", "x double").count() == 0
    assert tables.read_parquet_or_csv(spark, f"file://{tmp_path}/a", "x double, s string").count() == 2
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert [r["values"] for r in tables.read_arrays(spark, f"file://{tmp_path}/m.npy").orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    parts = {f"{n}_{r}": np.arange(2.0) for n in ("y", "ref", "alt") for r in ("val", "test")} | {f"{r}_indices": np.array([4, 9]) for r in ("val", "test")}
    np.savez(tmp_path / "T_split1_seed2.npz", **parts)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.write(tmp_path / "T_split1_seed2.npz", "dir/T_split1_seed2.npz")
    rows = tables.read_paired_predictions(spark, f"file://{tmp_path}/p.zip").collect()
    assert len(rows) == 4 and {(r.task, r.split_seed, r.seed, r.row) for r in rows} == {("T", 1, 2, 4), ("T", 1, 2, 9)}
    tables.write_table(got, f"file://{tmp_path}/out", ["s"])
    assert sorted(d for d in os.listdir(tmp_path / "out") if d.startswith("s=")) == ["s=a", "s=b", "s=c"]
    digests = tables.file_digests(spark, f"file://{tmp_path}/*.csv")
    manifest = spark.createDataFrame([("a.csv", digests.where("name = 'a.csv'").first().sha256), ("b.csv", "0"), ("c.csv", "0")], "name string, sha256 string")
    assert sorted(tuple(r) for r in tables.check_manifest(digests, manifest).collect()) == [("b.csv", "mismatch"), ("c.csv", "missing")]
    assert tables.markdown(got.where("x > 0")) == "| x | s |\n| --- | --- |\n| 1.5 | a |"


def test_models_and_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), float(a > 0), float(2 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "mol_id long, f1 double, f2 double, c double, r double")
    out = models.out_of_fold(df, "linear", "classification", ["f1", "f2"], 3, label="c")
    assert out.count() == 120 and out.where("pred is null or pred < 0 or pred > 1").count() == 0
    auc = one(metrics.auroc(out.withColumn("g", F.lit(1)), ["g"], "c", "pred")).AUROC
    assert auc > 0.95
    pairs = models.pairwise_rows(df.withColumn("g", F.lit(1)), ["g"], "r", ["f1"], 2)
    assert models.pairwise_ranker(pairs, ["f1"]).stages[-1].coefficients[0] > 0
    blocks = df.select("mol_id", F.array("f1").alias("a"), F.array("r", "c").alias("b"))
    assert one(blocks.select(features.concatenated("a", "b").alias("x"))).x == [rows[0][1], rows[0][4], rows[0][3]]
    assert features.modality_dropout(blocks, "b").where("dropped and b[0] = 0").count() == 120
    noisy = features.corrupted(blocks, "a", blocks, 0.5, 3).select("a").collect()
    assert noisy == features.corrupted(blocks, "a", blocks, 0.5, 3).select("a").collect() and noisy[0].a != [rows[0][1]]


def test_stream_appends_closed_windows(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "gpu", float(d * 10 + h)) for d in (1, 2, 3) for h in (1, 2)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = monitor.samples(spark, f"file://{tmp_path}/in", "ts timestamp_ntz, kind string, value double")
    monitor.run_available(monitor.window_peaks(stream, "kind", "value"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "append")
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("start").collect()
    assert [(r.samples, r.peak) for r in got] == [(2, 12.0), (2, 22.0)]


@pytest.mark.parametrize("kind", ["long tail", "constant", "with nulls"])
@pytest.mark.parametrize("down", [False, True])
def test_running_cuts_evenly(spark, kind, down):
    value = {"long tail": "exp(pmod(hash(id), 97) / 3D)", "constant": "7D", "with nulls": "if(id % 3 = 0, null, pmod(hash(id), 11) * 1D)"}[kind]
    df = spark.range(3000).selectExpr("id % 2 AS g", "id", f"{value} AS x")
    got = ordered.running(df, ["g"], "x", {"n": F.lit(1).cast("long")}, down, ["id"], rows=100)
    for g in (0, 1):
        rows = [(r.x, r.id, r.n) for r in got.where(F.col("g") == g).collect()]
        want = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0] if down else r[0], r[1]))
        assert [r[2] for r in want] == list(range(1, 1501))
    place = ordered._place(df, "x", down, ["id"])
    sizes = df.join(ordered._cuts(df, ["g"], place, 100, 4096), "g").withColumn("s", ordered._stretch(place)).groupBy("g", "s").count()
    counts = sorted(r["count"] for r in sizes.collect())
    assert sum(counts) == 3000 and len(counts) >= 26 and counts[-1] <= 4 * 100


def test_many_stretches(spark):
    df = spark.range(20_000).selectExpr("0 AS g", "id AS i", "cast(pmod(hash(id), 5000) as double) AS x")
    got = ordered.running(df, ["g"], "x", {"n": F.lit(1).cast("long")}, rows=50)
    counts = {}
    for r in df.collect():
        counts[r.x] = counts.get(r.x, 0) + 1
    to, total = {}, 0
    for x in sorted(counts):
        total += counts[x]
        to[x] = total
    assert all(r.n == to[r.x] for r in got.collect())


def test_discounts_of_long_runs(spark):
    runs = [(1, 10), (1, 64), (1, 65), (3, 70), (1, 1000), (500, 200_000), (5, 4)]
    df = spark.createDataFrame(runs, "a long, b long").select("a", "b", metrics._discounts(F.col("a"), F.col("b")).alias("d"))
    for r in df.collect():
        assert r.d == pytest.approx(sum(1 / math.log2(k + 1) for k in range(r.a, r.b + 1)), rel=1e-10, abs=1e-10)
    assert df.sparkSession.range(1).select(metrics._discounts(F.lit(1), F.lit(10**12)).alias("d")).first().d > 2.4e10


def test_reports_are_whole(spark):
    assert tables.markdown(spark.range(3)).count("\n") == 4
    with pytest.raises(ValueError):
        tables.markdown(spark.range(4), rows=3)


def test_repeated_stream_batches(spark, tmp_path):
    spark.range(6).selectExpr("timestamp_seconds(id * 86400) AS ts", "'a' AS kind", "id * 1D AS v").write.parquet(str(tmp_path / "in"))
    stream = monitor.window_peaks(monitor.samples(spark, str(tmp_path / "in"), "ts timestamp, kind string, v double"), "kind", "v")
    for run in ("one", "two"):  # a new checkpoint gives the same batches again
        monitor.run_available(stream, str(tmp_path / "out"), str(tmp_path / run), "append")
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("start", "kind").count()
    assert rows.count() and rows.where("count > 1").count() == 0
