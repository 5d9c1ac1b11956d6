"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves, which are encoded alone. Two neighbours are joined by encoding a window around
their border anew. The window grows until the tokens outside are proven to stay, in one of two ways:

* Its ends lie at places where the split pattern always cuts and looks at nothing beyond: between something that is not
  white space and a space or line feed; between an ASCII letter and an ASCII digit; between one of these and ASCII
  punctuation. No alternative of the pattern spans them, and the alternatives that end before them look only at the
  next character, which ends them as the end of the text would.
* The window and some characters around it are of one kind (letters, numbers, or neither), so that one match of the
  pattern holds them all, and at both ends the token outside and the first token inside, encoded as a pair, give the
  same two tokens. A sequence of tokens in which every neighbouring pair encodes to itself is the encoding of the whole.

Only where neither holds within a half, the window takes the whole half. Joined values are again values, so the order
of joins does not matter. Decoding concatenates the bytes of both halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 1024
#: Characters to look for a cut in before a window grows by tokens.
NEAR = 256
#: A cut lies between the two characters of a match.
CUTS = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")


#: Kinds of characters of which a match has any number.
RUNS = [regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(r"[^\s\p{L}\p{N}]*")]


class Coder:
    """One vocabulary: the library encodes leaves and windows, this class halves and joins."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, leaf: int = LEAF):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pieces = {rank: piece for piece, rank in table.items()}
        self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for piece, rank in table.items():
            self.lengths[rank] = len(piece)
        self.leaf = leaf

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _encode(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf:
            return self._leaf(text[low:high])
        mid = (low + high) // 2
        return self.join(text, low, mid, high, self._encode(text, low, mid), self._encode(text, mid, high))

    def join(self, text: str, low: int, mid: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of text[low:high] from those of text[low:mid] and text[mid:high]."""
        a, b = self._before(text, max(low, mid - NEAR), mid), self._after(text, mid, min(high, mid + NEAR))
        if (a == mid - NEAR and a > low) or (b == mid + NEAR and b < high):
            joined = self._in_run(text, low, mid, high, left, right)
            if joined is not None:
                return joined
            a, b = self._before(text, low, mid), self._after(text, mid, high)
        keep_left = self._tokens(left, len(text[a:mid].encode()), from_end=True)
        keep_right = self._tokens(right, len(text[mid:b].encode()))
        return np.concatenate([left[: len(left) - keep_left], self._leaf(text[a:b]), right[keep_right:]])

    def _in_run(self, text: str, low: int, mid: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """Joins halves whose border lies in a run of one kind; None where a window would leave the run."""
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inner, outer = self._bytes(left[len(left) - i :]), self._bytes(right[:j])
            # a character has a byte at least; two letters after an apostrophe may be a match of their own
            around = text[max(low, mid - len(inner) - 3) : min(high, mid + len(outer) + 1)]
            if not any(run.fullmatch(around) for run in RUNS):
                return None
            new = self._piece(inner + outer)
            stays_left = i == len(left) or self._stays(left[len(left) - i - 1], new[0])
            stays_right = j == len(right) or self._stays(new[-1], right[j])
            if stays_left and stays_right:
                return np.concatenate([left[: len(left) - i], np.array(new, np.int32), right[j:]])
            i, j = i if stays_left else 2 * i, j if stays_right else 2 * j

    def _piece(self, piece: bytes) -> list[int]:
        return self.library._encode_single_piece(piece)

    def _stays(self, first: int, second: int) -> bool:
        return self._piece(self.pieces[int(first)] + self.pieces[int(second)]) == [first, second]

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def _tokens(self, ids: np.ndarray, n_bytes: int, from_end: bool = False) -> int:
        """How many tokens at one end make up so many bytes."""
        if not n_bytes:
            return 0
        ends = np.cumsum(self.lengths[ids[: -n_bytes - 1 : -1] if from_end else ids[:n_bytes]])
        return int(np.searchsorted(ends, n_bytes)) + 1

    @staticmethod
    def _before(text: str, low: int, mid: int) -> int:
        size = 64
        while mid - size > low:
            found = [m.start() for m in CUTS.finditer(text, mid - size, mid) if m.start() > mid - size]
            if found:
                return found[-1]
            size *= 2
        found = [m.start() for m in CUTS.finditer(text, low, mid) if low < m.start()]
        return found[-1] if found else low

    @staticmethod
    def _after(text: str, mid: int, high: int) -> int:
        found = CUTS.search(text, mid + 1, high)
        return found.start() if found and found.start() < high else high

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self._bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(2)
def coder(ranks: bytes) -> Coder:
    return Coder(ranks)


def vocabulary(spark, name: str = RANKS):
    """The rank file, under 1 MB, sent to every executor once."""
    with open(path(name), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(spark, name: str = RANKS):
    """A column function: text to array<int> of token ids; null counts as empty."""
    ranks = vocabulary(spark, name)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        c = coder(ranks.value)
        ids = [c.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))

    return encode


def decoder(spark, name: str = RANKS):
    """A column function: array<int> of token ids to bytes."""
    ranks = vocabulary(spark, name)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        c, flat = coder(ranks.value), lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(lists).to_pylist())])
        return pa.array([c.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return decode


def encode_documents(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """Adds `ids`, the token ids of the whole text (null: none), to every row; repeated rows are encoded alike.

    An empty text has no ids, an empty table gives an empty result, a column of docs that is called ids is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("ids", encoder(docs.sparkSession, name)("text"))


def decode_documents(encoded: DataFrame, name: str = RANKS) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for, to every row; null ids give no bytes."""
    small_batches(encoded.sparkSession)
    return encoded.withColumn("decoded", decoder(encoded.sparkSession, name)("ids"))
