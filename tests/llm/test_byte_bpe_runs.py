"""Joins within long runs, where the pattern cuts nowhere, against the library."""

import random

import pytest
from public_tokenizers import path

from tandem.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    with open(path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.mark.parametrize("leaf,near", [(1, 1), (5, 4), (64, 256)])
def test_runs_equal_the_library(ranks, leaf, near, monkeypatch):
    monkeypatch.setattr(byte_bpe, "NEAR", near)
    coder, rng, taken = byte_bpe.Coder(ranks, leaf=leaf), random.Random(leaf), []
    inner = coder._in_run

    def watched(*args):
        joined = inner(*args)
        taken.append(joined is not None)
        return joined

    coder._in_run = watched
    kinds = ["a", "the", "日本", "語", "!!", "##", "12", "9", " ", "\n", "'s", "'", "é", "ا", "ing", "𝒜", "'ll", "x" * 9, "́", "ſ"]
    for _ in range(400):
        some = rng.sample(kinds, rng.randrange(1, 6))
        text = "".join(rng.choice(some) for _ in range(rng.randrange(1, 90)))
        assert coder.encode(text).tolist() == coder.library.encode_ordinary(text), repr(text)
    assert leaf > 5 or any(taken)


@pytest.mark.parametrize("text", ["a" * 50_000, "日本語文章" * 8_000, "ab!" * 20_000, "=" * 3_000, "'ll" * 9_000, " " * 5_000])
def test_long_runs(ranks, text):
    coder = byte_bpe.Coder(ranks)
    got = coder.encode(text)
    assert got.tolist() == coder.library.encode_ordinary(text) and coder.decode(got) == text.encode()


def test_a_run_is_not_encoded_again_at_every_level(ranks):
    coder, sizes = byte_bpe.Coder(ranks), []
    inner = coder._piece
    coder._piece = lambda piece: sizes.append(len(piece)) or inner(piece)
    coder.encode("日本語文章" * 8_000)
    assert max(sizes) < 500
