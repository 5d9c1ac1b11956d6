"""The language filters against sets of n-grams, and held-out accuracy."""

import numpy as np
import pyarrow as pa

from tandem.llm import language_id


def plain_grams(text):
    """(n-gram) counts of a text by its definition."""
    letters = "\0" + "".join((x if len(x := c.lower()) == 1 else c) if c.isalpha() else "\0" for c in text) + "\0"
    out = []
    for n in language_id.SIZES:
        out += [g for g in (letters[i : i + n] for i in range(len(letters) - n + 1)) if "\0" not in g[1:-1]]
    return out


def test_ngrams_by_their_definition(monkeypatch):
    texts = ["The cat's tail, 3 a.b", None, "", "日本語テキスト İIı ǅß", "x" * 50 + " " + "ab " * 40, "\x00 é1é", "a", "ab", "abc"]
    whole = [np.sort(language_id.ngrams(*next(language_id.pieces([t])))[0]) if t else np.zeros(0) for t in texts]
    numbers = {}
    for text, hashes in zip(texts, whole, strict=True):
        grams = plain_grams(text or "")
        assert len(grams) == len(hashes) and len(set(grams)) == len(set(hashes.tolist()))
        numbers[text] = hashes
    # cut into pieces of any size, together with other texts, the same n-grams come out
    for piece in (1, 2, 5, 17):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = [[] for _ in texts]
        for code, of in language_id.pieces(texts):
            for h, k in zip(*language_id.ngrams(code, of), strict=True):
                got[k].append(h)
        for text, hashes in zip(texts, got, strict=True):
            assert np.array_equal(np.sort(np.array(hashes, np.uint64)), numbers[text]), (piece, text)


def test_filters_hold_all_languages_of_an_ngram(spark):
    words = {"a": ["abcd", "same", "tail"], "b": ["wxyz", "same"], "c": ["tail", "mnop"]}
    rows = [(i, " ".join(words[lang]), lang) for i, lang in enumerate("abc" * 6)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == set(words)
    for word in ("abcd", "same", "tail", "wxyz", "mnop"):
        total, found = model.hits([word])
        for i, lang in enumerate(model.languages):
            assert (found[0, i] == total[0]) == (word in words[lang])
        best, score = model.predict([word])
        assert word in words[best[0]] and 0 < score[0] <= 1


def test_chance_hits_are_taken_off():
    rng = np.random.default_rng(1)
    table = np.where(rng.random(1 << 12) < 0.5, np.uint64(1), np.uint64(0)) | np.uint64(0)  # a half-full filter of nothing
    model = language_id.Model(["full", "empty"], table, np.array([0.5**language_id.PROBES, 0.0]))
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(5000))
    total, found = model.hits([text])
    assert abs(found[0, 0] / total[0] - 0.125) < 0.01 and found[0, 1] == 0
    assert model.predict([text])[1][0] < 0.02


def test_counts_are_summed_whatever_is_held(monkeypatch):
    texts = ["one two three", "two three four", "five"] * 5
    batch = pa.record_batch({"bit": pa.array([0, 1, 0] * 5, pa.int32()), "text": texts})
    def total():
        out = {}
        for b in language_id.counted(iter([batch, batch])):
            for bit, gram, n in zip(*(b[c].to_pylist() for c in ("bit", "gram", "n")), strict=True):
                out[bit, gram] = out.get((bit, gram), 0) + n
        return out

    want = total()
    monkeypatch.setattr(language_id, "HELD", 5)
    monkeypatch.setattr(language_id, "PIECE", 4)
    assert total() == want and sum(want.values()) == 2 * sum(len(plain_grams(t)) for t in texts)


def test_held_out_accuracy_and_contract(spark, sf):
    from tandem.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op11_language_id(spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(20)] + [(i, "der hund und die katze", "de", 1) for i in range(20, 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(table)
    assert model.languages[0] == "de"
    odd = [None, "", "123 !?", "½ ²", "the dog", "Die KATZE", "жжж", "the dog " * 100_000]
    asked = spark.createDataFrame([(i if i else None, t, "xx", 5, "y") for i, t in enumerate(odd)], "doc_id long, text string, lang string, score int, lang_pred string")
    got = language_id.identify(asked, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r.text: (r.lang_pred, r.score) for r in got.collect()}
    assert [got[t][0] for t in odd] == ["und"] * 4 + ["en", "de", "de", "en"]
    assert got["жжж"][1] == 0 == got[None][1]
    assert language_id.identify(asked.limit(0), model).count() == 0
    none = language_id.train(table.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.identify(asked, none).collect()} == {("und", 0.0)}
