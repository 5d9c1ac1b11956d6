"""Decontamination, byte-level BPE, bit packing, token counts, URL filter and sharding against brute force."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import PATTERN, path

from tandem.llm import bit_packing, byte_bpe, decontamination, sharding, token_counts, url_filter
from tandem.llm.queries import URL_RULES

DOCS = "text string, doc_id long, hits string, ids string, items string, n int"
ODD = [
    (None, 1), ("", 2), (" \n ", 3), ("a" * 30000, 4), ("word " * 9000, 5), ("same text here", 6), ("same text here", 7),
    ("same text here", 7), ("no id", None), ("don't 12abc!? naïve çeç  \t x\x0b\x1cy 'S", 8), ("日本語" * 3000, 9),
    ("one two three four five six seven eight nine ten eleven twelve", 10), ("THREE four", 11), (" 1 2  " * 3000 + "'ll", 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t, i, "x", "y", "z", 0) for t, i in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def upper_down(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", upper_down(text))


def brute_decontamination(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        if not n:
            continue
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in windows:
                hit.update(range(s, s + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit)


ITEMS = [
    (1, "two three four five six seven eight nine ten eleven"), (2, "three FOUR"), (3, ""), (4, None), (5, "word " * 12), (6, "absent thing"),
    (10, "zero one two three four five six seven eight nine ten"), (None, "same"), (2, "three FOUR"),
]


@pytest.mark.parametrize("broadcast_words", [50_000, 0])
def test_decontamination(spark, docs, empty, monkeypatch, broadcast_words):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", broadcast_words)
    benchmark = spark.createDataFrame([(t, i, 1) for i, t in ITEMS], "text string, item_id long, doc_id int")
    got = sorted(map(str, (tuple(r) for r in decontamination.decontaminate(docs, benchmark).drop("text_hash").collect())))
    assert got == sorted(str((i, *brute_decontamination(t, ITEMS))) for t, i in ODD)
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    none = decontamination.decontaminate(docs, benchmark.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none)


def test_byte_bpe(spark, docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(empty)).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 32])
def test_byte_bpe_joins(leaf):
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    c, rng = byte_bpe.Coder(data, leaf=leaf), random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "'", "1", "2", "!", "é", " ", "\x1c", "the", "'ll", "日", "\t"]) for _ in range(rng.randrange(60)))
        want = c.library.encode_ordinary(text)
        assert c.encode(text).tolist() == want and c.decode(np.array(want, np.int32)) == text.encode()


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint32)
    packed = bit_packing.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (bit_packing.unpack(packed, bits, 0, 1000) == ids).all() and (bit_packing.unpack(packed, bits, 37, 501) == ids[37:538]).all()


def test_packed_documents(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    bits = bit_packing.write_packed(docs, f"file://{tmp_path}/p", 2, block=50)
    rows = bit_packing.read_packed(spark, f"file://{tmp_path}/p").orderBy("start").collect()
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t, i in ODD}
    assert bits == 16 and [r.doc_id for r in rows] == sorted((i for _, i in ODD), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert bytes(r.ids) == want[r.doc_id] and r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    assert bit_packing.pack_documents(empty, end_id=2).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(path("word_bpe_49k.json")), random.Random(8)
    known = bit_packing.Words(open(path("word_bpe_49k.json"), "rb").read())
    letters = ["a", "B", "é", "É", "İ", "ß", "ŉ", "ǅ", "ª", "²", "½", "e\u0301", "Σ", "ς", "ﬁ", "日", "'", "S", "'ll", "1", "9", "!", "\x7f", "\xad", "\xa0", "\x0b", "\x1c", "\x85", " ", "\n", "\u2028", "<|endoftext|>", "\u200d", "🎉", "Ⅷ", "th", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for t, got in zip(texts, known.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_latin_character_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    known = bit_packing.Words(open(path("word_bpe_49k.json"), "rb").read())
    texts = [form.format(chr(c)) for c in range(0x250) for form in ("{}", "{}b", "a{}", "a{}b", "A{0}{0}B c{0}", "3{}4", "{0} {0}")]
    texts += ["\u018fli B\u0259y", "K\u0186K\u0186 d\u0254", "\u0181\u018a h\u0198"]
    for t, got in zip(texts, known.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_packing_query_against_the_library(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    from tandem.llm import queries

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = [None, "", "\u018fli B\u0259y, \u0181a\u0199i", "two  words\n", "\u65e5\u672c\u8a9e", "a b " * 70_000, "two  words\n"]
    rows = [(k * 37 % 101, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_bit_packing(spark, str(tmp_path)).collect()}
    start, want = 0, {}
    for doc_id, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_is_greedy():
    rng = random.Random(1)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        automaton = token_counts.Automaton(pieces)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(docs, empty):
    vocabulary = json.load(open(path("word_bpe_49k.json")))["model"]["vocab"]
    symbols = token_counts.byte_characters()
    pieces = {re.sub("(.)</w>$", lambda m: chr(ord(m[1]) + 10_000), p) for p in vocabulary}  # one character for each symbol
    longest = max(map(len, pieces))

    def count(word):
        w, n, at = "".join(symbols[b] for b in word[:-1]) + chr(ord(symbols[word[-1]]) + 10_000), 0, 0
        while at < len(w):
            at, n = next(e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in pieces), n + 1
        return n

    for r in token_counts.count_tokens(docs).collect():
        assert r.n_tokens == sum(map(count, (r.text or "").encode().lower().split()))
    assert token_counts.count_tokens(empty).count() == 0


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    p = re.match("[^?#]*", rest[len(host) :])[0]
    host = upper_down(host)
    fits = [(len(h + q), h + q, v) for v, h, q in URL_RULES if (host == h or host.endswith("." + h)) and p.startswith(q)]
    return host, p, max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x", "http://example.com/en/8", "https://x.net/de/8", "ftp://example.net/de/8://", "http://org/es/#a",
            "http://org", "http://notcom/en/", "http://acom/en/", "://com/en/", "http://a.org?/es/", "http://a.org/es/1", "http://a.org/es/1", "http://b.ORG/ES/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.net/de/1", "r")], "page_id long, url string, rule string")
    rows = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, p, (rule, verdict) = brute_url("http://a.net/de/1" if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, p, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_url_templates(spark):
    rows = [(i, f"http://s.example/{['spam', 'news'][i % 2]}/{i}/x", i % 2 == 0) for i in range(40)]
    rows += [(40 + i, f"http://t.example/a{i}/b", None) for i in range(20)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows[:36] if r[2] is not None], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, [], labels).collect()}
    assert all(got[i].template == f"/{['spam', 'news'][i % 2]}/*/x" and got[i].verdict == ["block", "allow"][i % 2] for i in range(40))
    assert all(got[40 + i].template == "/*/b" and got[40 + i].verdict == "allow" for i in range(20))


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t, i in ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign_shards(empty, 4).count() == 0


def test_ring_walk_equals_one_key_at_a_time():
    rng = np.random.default_rng(3)
    for slack in (0.0, 0.1):
        for _ in range(20):
            slots, shards = 16, int(rng.integers(1, 6))
            order = sharding.ring(shards, 3, slots)
            counts = rng.poisson(0.7, slots * 5)
            room = sharding.capacities(int(counts.sum()), shards, slack)
            left, want = room.copy(), []
            for cell, n in enumerate(counts):
                for k in range(n):
                    s = next(s for s in order[cell % slots] if left[s])
                    want.append((cell, k, s, room[s] - left[s]))
                    left[s] -= 1
            got = [(p.cell, p.first + k, p.shard, p.base + k) for p in sharding.fill(counts, order, room).itertuples() for k in range(p.n)]
            assert sorted(got) == sorted(want)


def test_query_digests(spark, sf):
    from tandem.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = byte_bpe.Coder(open(path("byte_bpe_50k.tiktoken"), "rb").read())
    assert len(rows) == len(texts)
    for i, t in list(texts.items())[:200]:
        ids = c.library.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
