"""Top-k against brute force; the quality classifier against enumeration and held-out labels."""

import itertools
import math

import numpy as np
import pytest

from tandem.llm import line_quality, top_k


@pytest.mark.parametrize("spread,levels", [(1, 8), (3, 8), (300, 3), (300, 30)])
def test_block_top(spread, levels):
    rng = np.random.default_rng(spread)
    early = 0
    for _ in range(25):
        n, dims = int(rng.integers(1, 300)), int(rng.integers(1, 12))
        ids = rng.permutation(1000)[:n].astype(np.int64)
        vectors = rng.integers(-spread, spread + 1, (n, dims))
        vectors[rng.random(n) < 0.3] = vectors[0]
        block = top_k.Block(ids, vectors)
        for q in range(4):
            query, own = rng.integers(-spread, spread + 1, dims), int(ids[0]) if q % 2 else -1
            got_ids, got_scores, proof = block.top(query, own, 5, levels)
            early += proof
            want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)[:5]
            assert [(-int(s), int(i)) for i, s in zip(got_ids, got_scores, strict=True)] == want
    assert early


def test_search(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 40)
    monkeypatch.setattr(top_k, "QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 180)]
    odd = [(200, None), (250, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (300, [math.nan] * 6), (350, [math.inf] * 6), (400, []), (None, [1.0] * 6), (450, [1.0, 2.0]), (500, [2.0, 2.0]), (10, rows[10][1]), (11, [-9.0] * 6)]
    table = spark.createDataFrame([(v, i, 3) for i, v in rows + odd], "embedding array<float>, vec_id long, score int")
    got = {}
    for r in top_k.search(table, table["vec_id"] % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    # as floats, as the table has them
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in [*rows, (450, [1.0, 2.0]), (500, [2.0, 2.0])]}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert top_k.search(table.limit(0), table["vec_id"] % 50 == 0).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 2])
    scores, moves = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, pairs, whole = line_quality.forward_backward(scores, moves, lengths)
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=n))
        p = np.array([sum(scores[at + i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)) for path in paths])
        assert math.isclose(whole[k], np.log(np.exp(p).sum()))
        p = np.exp(p - whole[k])
        for i in range(n):
            assert math.isclose(good[at + i], sum(x for x, path in zip(p, paths, strict=True) if path[i]))
        for x, path in zip(p, paths, strict=True):
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += x
        at += n
    assert np.allclose(pairs, want_pairs)


def test_features_are_finite_and_per_line():
    texts = [None, "", "\n\n", "Good line.\nBAD!! BAD!!\nGood line.", "x" * 50_000, "é ü\r\n\t", "a a a a"]
    x, sizes, n_lines = line_features = line_quality.line_features(texts)
    assert n_lines.tolist() == [1, 1, 3, 3, 1, 2, 1] and len(x) == len(sizes) == 12 and np.isfinite(x).all()
    alone = line_quality.line_features(texts[3:4])[0]
    assert np.allclose(alone, x[5:8])
    assert line_features[1].sum() == sum(len((t or "").encode()) + 1 for t in texts)


def test_scores(spark, sf):
    from tandem.llm.queries import QUERIES

    rows = QUERIES["op7_line_quality"](spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(y == p for y, p, _ in held) / len(held)
    pairs = [(a > b) + (a == b) / 2 for y, _, a in held if y for z, _, b in held if not z]
    print(len(held), right, sum(pairs) / len(pairs))
    assert right > 0.95 and sum(pairs) / len(pairs) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, 1, "a"), ("", 2, "b"), ("", 2, "b"), ("word " * 9000, None, "c")], "text string, doc_id long, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = line_quality.train(docs, empty)
    assert [r.score for r in line_quality.score_documents(docs, model).collect()] == [0.5] * 4
    assert line_quality.score_documents(docs.limit(0), model).count() == 0
    model = line_quality.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (7, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in line_quality.score_documents(docs, model).collect())
