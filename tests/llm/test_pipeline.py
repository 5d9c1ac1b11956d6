"""The pipeline's stages, each against brute force on its own input, and the whole."""

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_substring_dedup import brute as brute_repeats
from tests.llm.test_text_operators import brute_decontamination

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    outs = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r for r in out.collect()}
        before = sorted((i, r.text) for i, r in rows.items())
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if n == 0:
            right = [(i in after) == bool(labels[i]) for i in rows if i in labels]
            assert sum(right) / len(right) > 0.95
        if n == 1:
            groups, _ = brute_groups(before)
            assert set(after) == set(groups) and all(after[i] == rows[i] for i in after)
        if n == 2:
            for (i, text), gone in zip(before, brute_repeats(before, 100), strict=True):
                raw = text.encode()
                spans = [[m.start(), m.end()] for m in re.finditer(b"x+", bytes(120 if b in gone else 45 for b in range(len(raw))))]
                for s in spans:
                    while s[0] < s[1] and raw[s[0]] & 0xC0 == 0x80:
                        s[0] += 1
                    while s[0] < s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                        s[1] -= 1
                left = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True)).decode()
                assert (after[i].text, after[i].n_chars) == (left, len(left)) if i in after else gone and not left.strip(" ")
        if n == 3:
            assert set(after) == {i for i, t in before if not brute_decontamination(t, items)[3]}
        if n == 4:
            from tandem.llm import byte_bpe

            ids = byte_bpe.decode_documents(out)
            assert {r.doc_id: bytes(r.decoded).decode() for r in ids.collect()} == {i: t for i, t in before}
        print(pipeline.STAGES[n][0], len(rows), len(after))
        docs, rows = out, after
        outs.append(out)
    assert outs[-1].count() > 100
    whole = pipeline.run(spark, SF)
    assert sorted(whole.collect()) == sorted(outs[-1].collect())


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.schema(stage(spark, docs, SF).schema).parquet(f"{tmp_path}/{n}")
        assert out.count() == 0
        docs = out


def test_one_row_of_each_group(spark):
    near = lambda p, w: " ".join([f"{p}{i}" for i in range(60)] + [w])
    rows = [(None, near("a", "x"))] * 3 + [(None, near("a", "y")), (4, near("b", "x")), (4, near("b", "x")), (3, near("b", "y")), (None, near("b", "z"))]
    rows += [(7, near("c", "x"))] * 2 + [(None, None)] * 2 + [(8, "")] * 2 + [(None, "alone here")]
    docs = spark.createDataFrame([(i, t, "group", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept string, at int").repartition(3)
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    first = min((near("a", "x"), near("a", "y")), key=hashes.get)
    assert got == sorted([(None, first), (3, near("b", "y")), (7, near("c", "x")), (None, None), (None, None), (8, ""), (None, "alone here")], key=str)


def test_odd_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    clashing = ["score", "removed", "kept", "n_bytes", "key", "t1", "data", "spans", "group", "_id", "_row", "a.b"]
    docs = docs.select("*", *(F.concat_ws("-", F.lit(c), "doc_id", "source").alias(c) for c in clashing))
    carried = lambda r: all(r[c] == "-".join(str(x) for x in (c, r.doc_id, r.source) if x is not None) for c in clashing)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for n, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows and all(map(carried, rows))
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert n == 2 or {(r.doc_id, r.text) for r in rows} <= texts
        if n == 2:
            assert sum(r.text is None for r in rows) == 2


def test_decoded(spark):
    import hashlib

    texts = ["", None, "naïve 日本 \n\n  x1", "word " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pipeline.token_ids(spark, docs, SF).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
