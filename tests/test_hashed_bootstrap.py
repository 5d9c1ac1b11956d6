"""The hashed bootstrap and sign test against loops and against what theory says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import inference

P = 2**31 - 1


def hashed(row, turn, seed, modulus):
    x = (turn * 48271 + row * 40692 + seed * 69621 + 12345) % P
    x = (x * x + turn) % P
    x = (x * 16807 + row) % P
    return (x * x + 1) % P % modulus


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    return [("a", int(i), float(v)) for i, v in zip(rng.permutation(5000)[:900] * 7919 + 2**33, rng.normal(0.1, 1, 900), strict=True)] + [("b", i, 1.0) for i in range(5)] + [("a", 3, None)]


def test_weights_are_poisson(spark):
    df = spark.range(20_000).withColumn("w", S.poisson_weight("id", F.lit(7), 3))
    got = np.array([r.w for r in df.collect()])
    assert abs(got.mean() - 1) < 0.03 and abs(got.var() - 1) < 0.05 and got.max() >= 5


def test_quantiles_against_a_loop(spark, rows):
    df = spark.createDataFrame(rows, "task string, mol_id long, u double").repartition(4)
    got = {r.task: r for r in inference.hashed_quantiles(df, ["task"], "u", "mol_id", {"low": 0.025, "high": 0.975}, 400, 5).collect()}
    mine = [(i, v) for t, i, v in rows if t == "a" and v is not None]
    means = []
    for turn in range(400):
        w = np.array([sum(hashed(i % P, turn, 5, 1_000_000) >= c for c in S.POISSON) for i, _ in mine])
        means.append((w * [v for _, v in mine]).sum() / w.sum())
    assert np.allclose([got["a"].low, got["a"].high], np.percentile(means, [2.5, 97.5])) and got["a"].n == 901
    values = np.array([v for _, v in mine])
    half = 1.96 * values.std() / len(values) ** 0.5  # as wide as a normal interval, within a tenth or so
    assert abs((got["a"].high - got["a"].low) / (2 * half) - 1) < 0.12 and got["b"].low is None
    assert inference.hashed_lcb(df.limit(0), ["task"], "u", "mol_id").count() == 0


def test_sign_flips_against_a_loop(spark, rows):
    df = spark.createDataFrame(rows, "task string, mol_id long, u double").repartition(4)
    got = {r.task: r for r in inference.hashed_sign_test(df, ["task"], "u", "mol_id", 500, 2).collect()}
    mine = [(i, v) for t, i, v in rows if t == "a" and v is not None]
    mean, means = np.mean([v for _, v in mine]), []
    for turn in range(500):
        signs = [1 if hashed(i % P, turn // 16, 2, 1 << 16) >> (turn % 16) & 1 else -1 for i, _ in mine]
        means.append(np.mean([s * v for s, (_, v) in zip(signs, mine, strict=True)]))
    assert got["a"].p == max(1 / 500, np.mean(np.array(means) >= mean)) and got["a"].p_two == max(1 / 500, np.mean(np.abs(means) >= mean))
    assert abs(np.mean(means)) < 0.01 and 0 < got["b"].p <= 0.1
