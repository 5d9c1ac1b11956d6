"""Near-duplicates and components against brute force."""

import random

import pytest

from tandem.llm import near_dedup
from tandem.llm.common import Scratch
from tandem.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    """doc_id of each row to its component, by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return [low[root(i)] for i in range(len(rows))], sets


def corpus(seed, n_bases, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for b in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 200]))]
        if b % 3 == 0:
            base += shared
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts + ["", " \t", "one", "One", "two words", "TWO\x0bwords"], 10))


@pytest.mark.parametrize("seed,block,carried", [(1, 2048, 4096), (2, 4, 30)])
def test_against_all_pairs(spark, monkeypatch, seed, block, carried):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CARRIED", carried)
    rows = corpus(seed, 25, 14, 9)
    want, sets = brute(rows)
    docs = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, label string, n int").repartition(3)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for (d, _), w, s in zip(rows, want, sets, strict=True):
        assert (got[d].component_id, got[d].n_shingles, got[d].kept) == (w, len(s), w == d)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, None), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "alone here"), (5, "A b c d e f g")], "doc_id long, text string")
    rows = sorted(near_dedup.near_duplicates(docs).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == [
        ("1", 0, "1", True), ("3", 3, "3", True), ("3", 3, "3", True), ("5", 3, "3", False), ("None", 1, "None", False), ("None", 3, "3", False),
    ]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (9, 7), (50, 50)] + [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in components(edges, Scratch(spark, "t"), "c").collect()}
    want = {i: 100 for i in range(100, 141)} | {7: 3, 3: 3, 9: 3} | {i: 1000 for i in range(1000, 1100)}
    assert got == want


def brute_odd(rows):
    """Component of each row, where rows of one doc_id are one document and null doc_ids name nothing."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = sets[i] and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    ids = [[d for (d, _), x in zip(rows, label, strict=True) if x == y and d is not None] for y in label]
    return [min(i, default=None) if s else d for i, s, (d, _) in zip(ids, sets, rows, strict=True)]


def test_odd_ids_against_all_pairs(spark):
    rng = random.Random(3)
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    near = lambda w: " ".join(w[:-1] + ["edit"])
    a, b, c, d = (words(p, 60) for p in "abcd")
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(words("own", 104)))]  # a text with a partner, another alone
    rows += [(9, " ".join(b)), (None, near(b)), (None, " ".join(c)), (None, near(c)), (8, " ".join(d)), (8, near(c))]
    rows += [(rng.choice([None, 100, 101, 102 + i]), t) for i, (_, t) in enumerate(corpus(5, 12, 8, 6))]
    rows += rows[:5]
    want = brute_odd(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((i, len(shingles(t)), w, i is not None and i == w)) for (i, t), w in zip(rows, want, strict=True))
