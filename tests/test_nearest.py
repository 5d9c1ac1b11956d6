"""Nearest prints in bands against all pairs."""

import random

import pytest

from tandem.operators import nearest


def similarity(a, b):
    a, b = ([x & (2**64 - 1) for x in v or []] for v in (a, b))
    n = max(len(a), len(b))
    a, b = a + [0] * (n - len(a)), b + [0] * (n - len(b))
    both = sum((x & y).bit_count() for x, y in zip(a, b, strict=True))
    whole = sum(x.bit_count() for x in a) + sum(x.bit_count() for x in b) - both
    return both / whole if whole else 0.0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def prints(n, seed, families=8):
    """Sparse prints of few families, of many bit counts."""
    rng = random.Random(seed)
    heads = [[sum(1 << rng.randrange(64) for _ in range(k)) % 2**64 for _ in range(3)] for k in range(1, families + 1)]
    return [[signed((w ^ (1 << rng.randrange(64))) % 2**64) for w in rng.choice(heads)] for _ in range(n)]


@pytest.mark.parametrize("block", [5, 2048])
def test_against_all_pairs(spark, block):
    train = [(i, p) for i, p in enumerate(prints(120, 1))] + [(200, None), (201, []), (202, [0, 0, 0]), (203, [-1, -1, -1]), (7, [1])]
    queries = [(i + 60, p) for i, p in enumerate(prints(90, 2))] + train[:20] + [(None, train[3][1]), (500, None), (501, [0]), (203, [-1, -1, -1])]
    schema = "mol_id long, words array<long>"
    got = nearest.nearest_tanimoto(spark.createDataFrame(queries, schema).repartition(3), spark.createDataFrame(train, schema), "mol_id", "words", True, block)
    rows = got.collect()
    want = sorted((str(i), round(max(similarity(p, t) for j, t in train if i is None or j != i), 12)) for i, p in queries)
    assert sorted((str(r.mol_id), round(r.nearest, 12)) for r in rows) == want
    assert 0 < nearest.skipped_share(got, len(train)) < 1 and all(r.met <= len(train) for r in rows)


def test_near_neighbours_spare_most_pairs(spark):
    rng = random.Random(3)
    train = [(i, [signed(sum({1 << b for b in rng.sample(range(64), rng.randrange(4, 60))}))]) for i in range(400)]
    queries = [(1000 + i, p) for i, p in train[:100]]  # copies under other ids
    schema = "mol_id long, words array<long>"
    got = nearest.nearest_tanimoto(spark.createDataFrame(queries, schema), spark.createDataFrame(train, schema), "mol_id", "words", True)
    assert all(r.nearest == 1 for r in got.collect()) and nearest.skipped_share(got, 400) > 0.95


def test_no_other_item_and_support(spark):
    schema = "mol_id long, words array<long>, group_key string"
    train = spark.createDataFrame([(1, [3], "a"), (2, [7], "a"), (3, [8], None)], schema)
    one = train.where("mol_id = 1")
    assert [r.nearest for r in nearest.nearest_tanimoto(one, one, "mol_id", "words").collect()] == [None]
    assert [r.nearest for r in nearest.nearest_tanimoto(one, train.limit(0), "mol_id", "words").collect()] == [None]
    assert nearest.nearest_tanimoto(train.limit(0), train, "mol_id", "words").count() == 0
    asked = spark.createDataFrame([(1, [3], "a"), (9, [8], None), (10, [16], "z")], schema)
    got = {r.mol_id: (round(r.support, 6), round(r.ood, 6)) for r in nearest.support_features(asked, train, "mol_id", "words", "group_key").collect()}
    assert got == {1: (1.098612, 0.333333), 9: (0.0, 0.0), 10: (0.0, 1.0)}
