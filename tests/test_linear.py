"""Grouped linear and kernel models against closed forms and their conditions of optimality."""

import numpy as np
import pytest

from tandem.operators import linear

COLUMNS = "task string, mol_id long, a double, b double, c double, k double, y double, cls double"


def table(seed, n=60, groups=("p", "q")):
    rng = np.random.default_rng(seed)
    out = []
    for g in groups:
        x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 3]
        x[:, 2] += 0.001 * x[:, 1]
        y = np.sin(2 * x[:, 0]) + 0.01 * (x[:, 1] - 1000) + 0.1 * rng.normal(size=n) + 5
        out += [(g, i, *map(float, x[i]), 4.0, float(y[i]), float(y[i] + rng.normal() > 5.8)) for i in range(n)]
    return out


def scaled(rows):
    x = np.array([r[2:6] for r in rows])
    sd = x.std(0)
    sd[sd < 1e-12] = 1
    return (x - x.mean(0)) / sd, np.array([r[6] for r in rows]), np.array([r[7] for r in rows])


def parts(rows, got, name="pred"):
    found = {(r.task, r.mol_id): r[name] for r in got.collect()}
    for g in ("p", "q"):
        mine = [r for r in rows if r[0] == g]
        yield g, mine, np.array([found[g, r[1]] for r in mine])


def test_ridge_cv_leaves_one_out(spark):
    rows = table(1)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    model = linear.ridge_cv(df, ["task"], ["a", "b", "c", "k"])
    for i, (_, mine, got) in enumerate(parts(rows, model.predict(df))):
        z, y, _ = scaled(mine)
        errors = []
        for a in linear.PENALTIES:
            total = 0.0
            for out in range(len(y)):  # refitted without the row, the others scaled as with it
                rest = np.arange(len(y)) != out
                zc, yc = z[rest] - z[rest].mean(0), y[rest] - y[rest].mean()
                w = np.linalg.solve(zc.T @ zc + a * np.eye(4), zc.T @ yc)
                total += (y[out] - y[rest].mean() - (z[out] - z[rest].mean(0)) @ w) ** 2
            errors.append(total)
        a = linear.PENALTIES[int(np.argmin(errors))]
        assert model.penalty[i] == a
        w = np.linalg.solve(z.T @ z + a * np.eye(4), z.T @ (y - y.mean()))
        assert np.allclose(model.weights[i], w) and np.allclose(got, y.mean() + z @ w)


def test_balanced_logistic_is_optimal(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    model = linear.balanced_logistic(df, ["task"], ["a", "b", "c", "k"], "cls")
    for i, (_, mine, got) in enumerate(parts(rows, model.predict(df))):
        z, _, y = scaled(mine)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        assert np.allclose(z.T @ (w * (got - y)) + model.weights[i], 0, atol=1e-6) and abs((w * (got - y)).sum()) < 1e-6
        assert np.allclose(got, 1 / (1 + np.exp(-(z @ model.weights[i] + model.intercept[i]))))
    assert model.turns < 15


def test_one_class_missing_values_and_unknown_groups(spark):
    rows = [("p", i, float(i) if i % 3 else None, float("nan"), 1.0, 1.0, float(i), 1.0) for i in range(12)]
    rows += [("q", i, float(i), 2.0, 1.0, 1.0, 3.0, float(i % 2)) for i in range(6)] + [("r", 1, 1.0, 1.0, 1.0, 1.0, None, None), (None, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    features = ["a", "b", "c"]
    got = {(r.task, r.mol_id): r.pred for r in linear.balanced_logistic(df, ["task"], features, "cls").predict(df).collect()}
    assert got["p", 1] is None and got["r", 1] is None and got[None, 1] is None and 0 < got["q", 1] < 1
    got = {(r.task, r.mol_id): r.pred for r in linear.ridge_cv(df, ["task"], features).predict(df).collect()}
    assert got["p", 11] > got["p", 4] and abs(got["q", 2] - 3) < 1e-9 and got["r", 1] is None
    empty = linear.ridge_cv(df.limit(0), ["task"], features)
    assert [r.pred for r in empty.predict(df.where("task = 'q'")).collect()] == [None] * 6


def test_kernel_ridge_with_all_landmarks_is_exact(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    features = ["a", "b", "c", "k"]
    exact = {}
    model = linear.kernel_ridge(df, ["task"], features, penalty=0.03, landmarks=80, gamma=0.1)
    for g, mine, got in parts(rows, model.predict(df)):
        z, y, _ = scaled(mine)
        kernel = np.exp(-0.1 * ((z[:, None] - z[None]) ** 2).sum(2))
        exact[g] = kernel @ np.linalg.solve(kernel + 0.03 * np.eye(len(y)), y)
        assert np.abs(got - exact[g]).max() < 1e-3
    # 30 landmarks for 60 rows: within a twentieth of the targets' deviation
    for g, mine, got in parts(rows, linear.kernel_ridge(df, ["task"], features, penalty=0.03, landmarks=30, gamma=0.1).predict(df)):
        assert np.sqrt(((got - exact[g]) ** 2).mean()) < 0.05 * np.std([r[6] for r in mine])


def test_kernel_machines_are_optimal(spark):
    rows = table(4)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    features = ["a", "b", "c", "k"]
    model = linear.kernel_classifier(df, ["task"], features, "cls", landmarks=70)
    for i, (_, mine, got) in enumerate(parts(rows, model.predict(df))):
        z, _, y = scaled(mine)
        assert model.features.gamma[i] == pytest.approx(1 / 3)  # four features, one of which is constant
        f = model.features(i, z)
        assert np.allclose(got, f @ model.weights[i] + model.intercept[i])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        short = np.maximum(0, 1 - (2 * y - 1) * got)
        assert np.allclose(model.weights[i] / 10 - f.T @ (w * (2 * y - 1) * short), 0, atol=1e-6)
        assert ((got >= 0) == y).mean() > 0.75  # of classes drawn with much noise
    model = linear.kernel_regressor(df, ["task"], features, landmarks=70, gamma=0.1, strength=30.0, epsilon=0.05)
    for i, (_, mine, got) in enumerate(parts(rows, model.predict(df))):
        z, y, _ = scaled(mine)
        over = np.sign(got - y) * np.maximum(0, np.abs(got - y) - 0.05)
        assert np.allclose(model.weights[i] / 30 + model.features(i, z).T @ over, 0, atol=1e-6) and abs(over.sum()) < 1e-6
        assert np.abs(got - y).mean() < 0.3 * y.std()


def test_gram_sums(spark):
    rows = table(5, 20)
    got = {(r.task, r.i, r.j): r.value for r in linear.gram_sums(spark.createDataFrame(rows, COLUMNS), ["task"], ["a", "b"]).collect()}
    for g in ("p", "q"):
        x = np.array([[1.0, r[2], r[3], r[6]] for r in rows if r[0] == g])
        assert all(np.isclose(got[g, i, j], x[:, i] @ x[:, j]) for i in range(4) for j in range(i, 4))


def test_small_batches_are_added_up_together():
    """Rows of many small batches become one run of each group."""
    import pyarrow as pa

    def batch(a):
        i = np.arange(a, a + 10)
        return pa.record_batch({"_g": (i % 3).astype(np.int32), "_x": pa.array([[float(v), -float(v)] for v in i]), "_y": i.astype(float), "_w": np.ones(10), "_item": pa.array([str(v) for v in i])})

    runs = [r for b in linear.packed(iter([batch(a) for a in range(0, 100, 10)])) for r in b.to_pylist()]
    assert [r["_g"] for r in runs] == [0, 1, 2] and runs[1]["_y"][:3] == [1.0, 4.0, 7.0]
    assert runs[2]["_x"][:4] == [2.0, -2.0, 5.0, -5.0] and runs[2]["_item"][1] == "5" and sum(len(r["_w"]) for r in runs) == 100
