"""The filter audit against running every order over the documents."""

import itertools
import random
import re

from tandem.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """For every row of (doc_id, text, lang) the letters that it fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append(
            {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 10 * len(re.findall("[A-Z]", text)) > len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": again,
            }
        )
    return out


def brute(rows, labels):
    fails, want = failures(rows), {}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, name in enumerate(order, 1):
                gone = [k for k in left if mine[k][1][name]]
                after = [k for k in left if k not in set(gone)]
                failing = sum(f[name] for _, f in mine)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in mine)
                lost = lambda ids, gone=gone: sum(mine[k][0] in ids for k in gone)
                want[part, "".join(order), step] = [len(after), len(gone), failing - len(gone), alone, lost(good), lost(toxic)]
                left = after
        for name in "ABCDE":
            mine_steps = [(k, v) for k, v in want.items() if k[0] == part and k[1][k[2] - 1] == name]
            total = sum(v[1] for _, v in mine_steps)
            for _, v in mine_steps:
                v.append(total)
    return want


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, 0, 0) for i, t, lang in rows], "doc_id long, text string, lang string, mask int, n int")
    marks = spark.createDataFrame([(i, q, x, 1) for i, q, x in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute(rows, labels)
    return got


def test_orders_against_running_them(spark):
    rng = random.Random(5)
    words = [*"abcdefgh", "Über", "ÀÉ", "NO", "1|2", "#x", "a b", "日本語"]
    texts = [rng.choice([" ", "\n", "  \t"]).join(rng.choices(words[: rng.choice([8, 15])] + [f"w{k}" for k in range(rng.choice([1, 400]))], k=rng.choice([0, 3, 99, 100, 130]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(3, rows[3][1], "en"), (3, "other", "en"), (None, rows[5][1], "fr"), (None, rows[5][1], "fr"), (None, None, None), (-4, None, "en"), (900, "", "en")]
    rows += [(1000 + i, texts[0], "en") for i in range(80)]  # a text that a third of the rows share
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (9999, 1, 1)]
    got = check(spark, rows, labels)
    assert len(got) == 600 * 3


def test_empty_tables_and_long_texts(spark):
    assert check(spark, [], []) == {}
    long = "Word " * 300_000
    got = check(spark, [(1, long, "en"), (2, long, "en"), (3, None, "en")], [])
    assert got["en", "EABCD", 1] == [2, 1, 0, 0, 0, 0, got["en", "EABCD", 1][6]]


def test_failures_at_their_bounds(spark):
    hundred = " ".join(f"w{k}" for k in range(100))
    cases = {
        hundred: "",
        " ".join(f"w{k}" for k in range(99)): "A",
        " ".join([f"w{k}" for k in range(80)] + ["w0"] * 20): "",
        " ".join([f"w{k}" for k in range(79)] + ["w0"] * 21): "B",
        "A" + "b" * 9: "A",
        "A" + "b" * 8: "AC",
        "A" + "ß" * 9: "A",
        hundred + " |": "D",
        "": "A",
    }
    docs = spark.createDataFrame([(t,) for t in cases], "text string")
    c = filter_audit.text_failures(docs["text"])
    for row in docs.select("text", *(v.alias(k) for k, v in c.items())).collect():
        assert "".join(k for k in "ABCD" if row[k]) == cases[row.text], row.text[:20]
