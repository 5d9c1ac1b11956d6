"""Removal of repeated byte strings against brute force."""

import random

import numpy as np
import pytest

from tandem.llm import substring_dedup


def brute(rows, width):
    """For every row the removed bytes."""
    firsts = {}
    texts = [(d if d is not None else substring_dedup.LAST, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            firsts[w] = min(firsts.get(w, (d, s)), (d, s))
    out = []
    for d, raw in texts:
        gone = set()
        for s in range(len(raw) - width + 1):
            if firsts[raw[s : s + width]] < (d, s):
                gone.update(range(s, s + width))
        out.append(gone)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "日本", "abcdefghij", "x", "run", "\n", "token", str(rng.randrange(99))])
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = [text(40) for _ in range(3)], text(150)
    texts = []
    for i in range(60):
        parts = [text(rng.randrange(60))]
        if i % 2:
            parts += [rng.choice(shared), text(rng.randrange(30))]
        if i % 5 == 0:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "edit"
            parts.append(" ".join(words))
        if i % 7 == 0:
            parts += [parts[0]] * 2
        texts.append(" ".join(parts))
    rows = [(d, t) for d, t in enumerate(texts, 5)]
    rows += [(200, texts[3]), (1, texts[3]), (201, texts[9]), (201, texts[9]), (202, None), (203, ""), (204, "a" * 700), (205, "ab" * 300), (None, texts[4]), (None, shared[0]), (206, "z" * 99), (206, shared[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3)])
def test_against_all_windows(spark, seed, hot):
    rows = corpus(seed)
    want = brute(rows, 100)
    docs = spark.createDataFrame([(t, d, i, "x") for i, (d, t) in enumerate(rows)], "text string, doc_id long, at int, spans string").repartition(4)
    got = {r["at"]: r for r in substring_dedup.remove_repeats(docs, hot=hot, bucket=50, extra=("at",)).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        raw, r = (t or "").encode(), got[i]
        assert {b for s in r.removed for b in range(s.low, s.high)} == want[i], (d, i)
        assert r.doc_id == d and r.n_bytes == len(raw) and bytes(r.kept) == bytes(b for j, b in enumerate(raw) if j not in want[i])
        assert all(a.high < b.low for a, b in zip(r.removed, r.removed[1:]))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 0


def test_columns_against_sets():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = int(rng.integers(1, 40))
        table = rng.integers(0, 2, (m, 14), dtype=np.uint8)
        first, n = rng.integers(0, 5, m), rng.integers(1, 4, m)
        rank = rng.permutation(m)
        got = substring_dedup.repeated_windows(table, first, n, rank, 6)
        for i in range(m):
            for s in range(9):
                mine = [j for j in range(m) if first[j] <= s < first[j] + n[j] and (table[j, s : s + 6] == table[i, s : s + 6]).all()]
                assert got[i, s] == (i in mine and rank[i] > min(rank[j] for j in mine))


def test_whole_characters(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("日本語éa ") for _ in range(80)) for _ in range(4)]
    rows = [(i, texts[i % 4][rng.randrange(9) :] + texts[(i + 1) % 4][rng.randrange(9) :]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for r in substring_dedup.remove_repeats(docs, whole_characters=True).collect():
        assert bytes(r.kept).decode().encode() == bytes(r.kept)
        wide = [(s.low, s.high) for s in exact[r.doc_id].removed]
        assert all(any(a <= s.low <= a + 2 and b - 2 <= s.high <= b for a, b in wide) for s in r.removed)


def test_many_texts_of_one_key(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    shared = [text(20) for _ in range(40)]
    rows = [(rng.choice([None, 7, 9]), f"{text(rng.randrange(12))} {rng.choice(shared)} {text(rng.randrange(12))}") for _ in range(3000)]
    rows += [(i, t) for i, t in enumerate(shared[:10], 20)] + rows[:20]
    want = brute(rows, 100)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at int")
    got = {r["at"]: r for r in substring_dedup.remove_repeats(docs, extra=("at",)).collect()}
    assert len(got) == len(rows)
    for i, (_, t) in enumerate(rows):
        assert bytes(got[i].kept) == bytes(b for j, b in enumerate(t.encode()) if j not in want[i])
