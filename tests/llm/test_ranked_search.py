"""Ranked search against scoring every document, over blocks, segments, batches and shares."""

import math
import random
import re
from collections import Counter

import pytest

from tandem.llm import ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(ranked_search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    queries = {}
    for i, text in set(items):
        if i is not None:
            queries.setdefault(i, Counter()).update(terms(text))
    out = set()
    for i, query in queries.items():
        scored = []
        for (doc_id, _), c, x in zip(docs, counts, n, strict=True):
            score = 0
            for t, times in query.items():
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * weight * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * x * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out |= {(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def run(spark, docs, items, k, **options):
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, item int")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    rows = ranked_search.search(left, right, k, **options).collect()
    got = {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("share,head,batch,bits", [(0.5, 100, 20_000, 12), (1.0, 2, 30, 3), (0.1, 1, 20_000, 4)])
def test_against_every_document(spark, monkeypatch, share, head, batch, bits):
    monkeypatch.setattr(ranked_search, "BATCH", batch)
    monkeypatch.setattr(ranked_search, "BLOCK_BITS", bits)
    monkeypatch.setattr(ranked_search, "SEGMENT", 7)
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 10 if bits == 3 else 1000)
    rng = random.Random(share)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["THE", "Über", "日本", "x_y", "no-one", "ÄÖ"]
    text = lambda n: rng.choice([" ", ", "]).join(["the", *rng.choices(words, k=n)])
    docs = [(i, text(rng.choice([0, 2, 5, 30]))) for i in range(120)]
    docs += [(i, docs[7][1]) for i in range(200, 230)] + [(None, docs[3][1]), (None, None), (5, docs[5][1]), (6, "another w1 w2"), (-1, ""), (-2, " ,.;_ ")]
    docs += [(300, " ".join(rng.choices(words, k=5000)))]
    items = [(i, text(rng.choice([1, 6, 20]))) for i in range(12)] + [(3, "w1 w1 w1 über"), (40, None), (41, "."), (42, "the the"), (43, "neverseen"), (None, "w1 w2"), (50, "w1"), (50, "w1"), (51, docs[7][1])]
    assert run(spark, docs, items, 5, share=share, head=head, probe=6) == brute(docs, items, 5)


def test_few_and_none(spark):
    docs = [(1, "alpha beta"), (2, "beta"), (3, "gamma")]
    assert run(spark, docs, [(1, "Beta ALPHA"), (2, "delta")], 20) == brute(docs, [(1, "Beta ALPHA"), (2, "delta")], 20) != set()
    assert run(spark, [], [(1, "beta")], 20) == set()
    assert run(spark, docs, [], 20) == set()
    with pytest.raises(ValueError):
        run(spark, docs, [(1, "beta")], 20, share=1.5)
