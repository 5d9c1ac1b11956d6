"""Group folds against dealing one group after the other."""

import random

import numpy as np
import pytest

from tandem.operators import splits


def loop(rows, n, labelled):
    """Fold of every group, from (group, label) rows, one group at a time."""
    names = sorted({str(y) for _, y in rows}) if labelled else [""]
    table = {}
    for g, y in rows:
        table.setdefault(g, [0] * len(names))[names.index(str(y)) if labelled else 0] += 1
    whole = np.maximum(1, np.sum(list(table.values()), axis=0))
    order = sorted(table, key=lambda g: (-round(float(np.std(table[g]) if len(names) > 1 else table[g][0]), 12), [-x for x in table[g]], g is not None, g if g is not None else 0))
    have, out = np.zeros((n, len(names)), int), {}
    for g in order:
        scores = []
        for k in range(n):
            tried = have.copy()
            tried[k] += table[g]
            scores.append((round(float((tried / whole).std(0).mean()), 11), have[k].sum(), k))
        out[g] = min(scores)[2]
        have[out[g]] += table[g]
    return out, have


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("labelled", [True, False])
def test_against_a_loop(spark, seed, labelled):
    rng = random.Random(seed)
    rows, sizes = [], [1, 1, 1, 2, 3, 3, 20]
    for g in range(150):
        share = rng.random()
        rows += [(g, int(rng.random() < share)) for _ in range(rng.choice(sizes))]
    rows += [(None, 1), (None, 0), (1000, 1)] + [(2000, 0)] * 90
    df = spark.createDataFrame([("t", g, y, i) for i, (g, y) in enumerate(rows)], "task string, group_key long, y int, fold int")
    got = splits.group_folds(df, ["task"], "group_key", 5, "y" if labelled else None).collect()
    want, have = loop(rows, 5, labelled)
    assert len(got) == len(rows) and {(r.group_key, r.fold) for r in got} == set(want.items())
    if labelled:
        assert (have[:, 1] / have[:, 1].sum()).std() < 0.1


def test_many_equal_groups_follow_a_cycle():
    shapes, times = np.array([[50, 0], [3, 1], [1, 1], [0, 1]]), np.array([1, 1003, 10**9, 7])
    dealt = splits.dealt_folds(shapes, times, 4)
    assert sum(len(first) for first, _ in dealt) < 200 and all(len(cycle) in (0, 4) for _, cycle in dealt)
    # the same without skipping
    few = splits.dealt_folds(shapes[:2], times[:2], 4)[1]
    assert few[0] + [few[1][k % 4] for k in range(1003 - len(few[0]))] == _one_by_one(shapes[:2], times[:2])[1:]


def _one_by_one(shapes, times):
    have, whole, out = np.zeros((4, 2), int), np.maximum(1, (shapes * times[:, None]).sum(0)), []
    for shape, m in zip(shapes, times, strict=True):
        for _ in range(m):
            spread = [((have + np.eye(4, dtype=int)[k][:, None] * shape) / whole).std(0).mean() for k in range(4)]
            out.append(min(range(4), key=lambda k: (round(spread[k], 11), have[k].sum(), k)))  # noqa: B023
            have[out[-1]] += shape
    return out
