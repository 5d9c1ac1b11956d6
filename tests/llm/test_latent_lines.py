"""Lines that differ from their document's label."""

import numpy as np

from tandem.llm import line_quality


def test_latent_lines():
    n = np.array([2, 3, 1])
    got = line_quality.latent_lines(np.array([1.0, 0.0, 0.0]), np.array([0.1, 0.9, 0.9, 0.2, 0.6, 0.99]), n)
    assert got.tolist() == [1, 1, 1, 0, 1, 0]  # a good document is good throughout, a bad one keeps its worst line


def test_the_chain_switches_within_documents(spark, sf):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice(list("ABCDEF"), 6)) + "!!" for _ in range(12))
    texts, labels, lines = [], [], []
    for i in range(400):
        kinds = [True] * 8 if i % 2 else [True] * 3 + [False] * 5
        texts.append("\n".join(good() if k else bad() for k in kinds))
        labels.append(float(i % 2))
        lines.append(kinds)
    model = line_quality.fit(texts[:300], np.array(labels[:300]))
    x, _, n_lines = line_quality.line_features(texts[300:])
    found = line_quality.forward_backward(x @ model.weights, model.moves, n_lines)[0] > 0.5
    # the good line before the bad ones cannot be told: a good line whose next line is bad occurs in bad documents only
    found, lines = found.reshape(-1, 8), np.array(lines[300:])
    clear = np.arange(8) != 2
    assert (found == lines)[:, clear].mean() > 0.95 and (found.any(1) & ~found.all(1)).sum() >= 45
    scores = model.quality(texts[300:])
    assert ((scores >= 0.3) == np.array(labels[300:])).mean() > 0.95


def test_long_texts_are_scored_but_not_fitted_on(spark):
    docs = spark.createDataFrame([(1, "word " * 9000), (2, "A!! " * 50), (9, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 9)], "doc_id long, quality int")
    one = line_quality.train(docs, labels, longest=1000)
    other = line_quality.train(docs.where("doc_id <> 1"), labels)
    assert np.allclose(one.weights, other.weights) and line_quality.score_documents(docs, one).count() == 3
