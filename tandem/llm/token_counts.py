"""Greedy longest-match token counts by a linear automaton, without building any piece.

The vocabulary is a trie. Every node has a failure link: the node that is left after the automaton has popped the
longest piece (and maybe more pieces) off the front of what it has read, and the number of pieces popped on the way.
So a word costs one step or failure for each character, and its count is a sum of stored numbers.

Words are what lies between ASCII white space, A-Z lower-cased, as byte characters, the last of them marked as the word's end
like the vocabulary's. The vocabulary has every byte with and without the mark, so every word can be spelt.
"""

from __future__ import annotations

import functools
import json
from collections import deque

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: Words a worker keeps the counts of, before it forgets them all and starts again.
CACHE = 500_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def symbols(piece: str) -> tuple[str, ...]:
    """The characters; a word end is one symbol with the last of them."""
    if piece.endswith(WORD_END) and len(piece) > len(WORD_END):
        at = len(piece) - len(WORD_END) - 1
        return (*piece[:at], piece[at:])
    return tuple(piece)


class Automaton:
    """Symbols are any hashable values; a word is a sequence of them that the vocabulary can always spell."""

    def __init__(self, pieces):
        self.next: list[dict] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][symbol]
            whole[node] = True
        #: None: nothing can be popped at this node, what was read cannot be spelt.
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, kid in self.next[node].items():
                if whole[kid]:
                    self.fail[kid], self.popped[kid] = 0, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at is not None and symbol not in self.next[at]:
                        n, at = n + self.popped[at], self.fail[at]
                    if at is not None:
                        self.fail[kid], self.popped[kid] = self.next[at][symbol], n
                queue.append(kid)

    def count(self, word) -> int:
        """The number of greedy longest-match pieces; -1 where there is no next piece."""
        next_, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for symbol in word:
            while symbol not in next_[node]:
                if fail[node] is None:
                    return -1
                n += popped[node]
                node = fail[node]
            node = next_[node][symbol]
        while node:
            if fail[node] is None:
                return -1
            n += popped[node]
            node = fail[node]
        return n


class Counter:
    def __init__(self, vocabulary: bytes):
        self.automaton = Automaton([symbols(p) for p in json.loads(vocabulary)["model"]["vocab"]])
        self.symbols = byte_characters()
        self.known: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        known, n = self.known, 0
        for word in text.encode().lower().split():
            got = known.get(word)
            if got is None:
                if len(known) > CACHE:
                    known.clear()
                got = self.automaton.count(symbols("".join(map(self.symbols.__getitem__, word)) + WORD_END))
                if len(word) <= 64:
                    known[word] = got
            n += got
        return n


@functools.lru_cache(2)
def counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Adds `n_tokens` to every row: greedy longest-match pieces of the whole text; 0 for null, empty or blank texts.

    Repeated rows count alike, an empty table gives an empty result, a column that is called n_tokens is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path(name), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # under 2 MB

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(vocabulary.value)
        return pa.array([c.count(t or "") for t in texts.to_pylist()], pa.int64())

    return docs.withColumn("n_tokens", count("text"))
