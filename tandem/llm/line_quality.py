"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from what it looks like and what its neighbours look like (shares of
upper case, symbols, digits, repeated words and so on, never the language, the source or the id), and neighbouring
lines have a transition score. Forward-backward gives each line's probability of being good; a document's quality is
their mean, weighted by the lines' lengths, through a logistic scale that is fitted on the training documents.

Labels are of documents, lines are latent: all lines of a good document are good, a bad one has at least one bad line and
may have good ones. Training starts with every line as its document, fits lines alone, and then takes turns: lines of
bad documents that the model takes for good become good, and the chain, with transitions as they now occur, is fitted
to the lines. The model is fitted on a bounded sample of labelled documents, the ones with the lowest hashes of their
ids, and is a few dozen numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled documents to fit on, at most; the others with labels are not needed.
SAMPLE = 6000
#: Bytes of a text to fit on, at most: documents with longer texts are scored, but not fitted on.
LONGEST = 1 << 16

_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 blank, 5 stop, 6 symbol
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[0xC0:] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[32, 9, 11, 12, 13, 10]] = 4
_KINDS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
OWN = 12


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes plus 1, and the number of lines of every text (1 at least)."""
    raws = [(t or "").encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.flatnonzero(data == 10)
    doc_ends = np.cumsum([len(r) for r in raws]) - 1
    n_lines = np.diff(np.searchsorted(ends, doc_ends, "right"), prepend=0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = (ends - starts + 1).astype(float)
    kinds = _KINDS[data]
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int64), starts) for k in range(7)], axis=1).astype(float)
    counts[:, 4] -= 1  # the line's end
    inside = kinds != 4
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    line = np.searchsorted(ends, first)
    total = np.zeros(len(data) + 1, np.uint64)
    power = np.cumprod(np.full(len(data), _BASE, np.uint64))
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    unpower = np.cumprod(np.full(len(data), np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64))
    hashed = lambda a, b: (total[b] - total[a]) * unpower[a]
    words = hashed(first, last + 1)
    m = len(starts)
    n_words = np.bincount(line, minlength=m).astype(float)
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])]) if len(words) else np.zeros(0, bool)
    by = np.lexsort((words, line))
    known = np.concatenate([[False], (words[by][1:] == words[by][:-1]) & (line[by][1:] == line[by][:-1])]) if len(words) else np.zeros(0, bool)
    symbol_end = kinds[last] == 6
    doc = np.repeat(np.arange(len(raws)), n_lines)
    whole = hashed(starts, ends)
    by_line = np.lexsort((np.arange(m), whole, doc))
    seen = np.zeros(m, bool)
    seen[by_line[1:]] = (whole[by_line][1:] == whole[by_line][:-1]) & (doc[by_line][1:] == doc[by_line][:-1])
    letters, tall = counts[:, 1] + counts[:, 2], sizes - 1
    share = lambda x, of, c=8.0: x / (of + c)  # noqa: E731  small lines say little
    per_line = lambda x: np.bincount(line[x], minlength=m).astype(float)
    own = np.stack(
        [
            np.log1p(tall) / 5,
            share(counts[:, 2], letters),
            share(counts[:, 6], tall),
            share(counts[:, 5], tall),
            share(counts[:, 3], tall),
            share(per_line(again), n_words, 2),
            share(np.bincount(line[by][known], minlength=m).astype(float), n_words, 2),
            share(per_line(symbol_end), n_words, 2),
            share(letters, n_words, 2) / 10,
            (n_words == 0).astype(float),
            (seen & (n_words > 0)).astype(float),
            share(counts[:, 0], tall),
        ],
        axis=1,
    )
    is_first = np.concatenate([[True], doc[1:] != doc[:-1]])
    is_last = np.concatenate([doc[1:] != doc[:-1], [True]])
    before = np.where(is_first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(is_last[:, None], 0, np.roll(own, -1, axis=0))
    squares = own[:, 1:8] ** 2
    return np.column_stack([np.ones(m), own, squares, before, after, is_first, is_last]).astype(np.float32), sizes, n_lines


def forward_backward(scores: np.ndarray, moves: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains with score `scores` for good and 0 for bad: each line's P(good), expected transitions, log partitions.

    All chains advance together, the longest first, so that every step works on a slice.
    """
    by = np.argsort(-n_lines, kind="stable")
    lengths, begin = n_lines[by], (np.cumsum(n_lines) - n_lines)[by]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    node = np.zeros((len(scores), 2))
    node[:, 1] = scores
    ahead, behind = np.empty_like(node), np.zeros_like(node)
    for t in range(steps):
        at = begin[: active[t]] + t
        ahead[at] = node[at] if t == 0 else node[at] + np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        rest = node[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(moves[:, 0] + rest[:, :1], moves[:, 1] + rest[:, 1:])
    ends = begin + lengths - 1
    whole = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    z = np.empty(len(scores))
    z[np.concatenate([np.arange(b, b + n) for b, n in zip(begin, lengths, strict=True)]) if len(begin) else []] = np.repeat(whole, lengths)
    good = np.exp(np.minimum(0, ahead[:, 1] + behind[:, 1] - z))
    inner = np.ones(len(scores), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + moves + (node[at] + behind[at])[:, None, :] - z[at][:, None, None]
    out = np.empty(len(by))
    out[by] = whole
    return good, np.exp(pair).sum(0), out


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float

    def quality(self, texts: list[str | None]) -> np.ndarray:
        x, sizes, n_lines = line_features(texts)
        good = forward_backward(x @ self.weights, self.moves, n_lines)[0]
        return 1 / (1 + np.exp(-(self.slope * _pooled(good, sizes, n_lines) + self.shift)))


def _pooled(good: np.ndarray, sizes: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    at = np.cumsum(n_lines) - n_lines
    return np.add.reduceat(good * sizes, at) / np.add.reduceat(sizes, at) - 0.5


def _climb(x, y, n_lines, weights, moves, chained: bool, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximises the penalised likelihood of the lines' labels; the transitions only if chained."""
    begin = np.cumsum(n_lines) - n_lines
    inner = np.ones(len(y), bool)
    inner[begin] = False
    at, seen = np.flatnonzero(inner), np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m = v = np.zeros(x.shape[1] + 4)
    for turn in range(1, rounds + 1):
        good, expected, _ = forward_backward(x @ weights, moves, n_lines)
        slope = np.concatenate([x.T @ (y - good), (seen - expected).ravel() * chained]) / len(y) - ridge * np.concatenate([weights, moves.ravel()])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        weights, moves = weights + step[:-4], moves + step[-4:].reshape(2, 2)
    return weights, moves


def latent_lines(labels: np.ndarray, good: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """The lines' labels under those of their documents: lines of bad documents are good where they probably are, but one."""
    begin = np.cumsum(n_lines) - n_lines
    y = np.maximum(np.repeat(labels, n_lines), good > 0.5)
    worst = np.lexsort((good, np.repeat(np.arange(len(n_lines)), n_lines)))[begin]
    y[worst] = labels
    return y


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 60, turns: int = 3, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Fits lines, then the chain to latent lines in turns, then the logistic scale; all deterministic."""
    # some texts at a time: what the features are made from is many times the texts' size
    parts = [line_features(texts[i : i + 128]) for i in range(0, len(texts), 128)]
    x, sizes, n_lines = (np.concatenate([p[i] for p in parts]) for i in range(3))
    y = np.repeat(labels, n_lines).astype(float)
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    for turn in range(turns):
        weights, moves = _climb(x, y, n_lines, weights, moves, turn > 0, rounds, rate, ridge)
        y = latent_lines(labels, forward_backward(x @ weights, moves, n_lines)[0], n_lines)
    pooled = _pooled(forward_backward(x @ weights, moves, n_lines)[0], sizes, n_lines)
    a, b = 4.0, 0.0
    for _ in range(50):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-(a * pooled + b)))
        w, r = p * (1 - p), labels - p
        h = np.array([[(w * pooled**2).sum() + 1e-2, (w * pooled).sum()], [(w * pooled).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(r * pooled).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        a, b = a + da, b + db
    return Model(weights, moves, float(a), float(b))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a null id is among them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fits on at most `sample` labelled documents of `longest` bytes or less outside the held-out fold. Null labels and unlabelled rows are skipped.

    Of several labels for a document the greatest counts. Without labels every document gets one half.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded side, small enough to broadcast
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    rows = sorted(rows.collect())
    if not rows:
        return Model(np.zeros(line_features([""])[0].shape[1]), np.zeros((2, 2)), 0.0, 0.0)
    return fit([r.text for r in rows], np.array([r.y for r in rows], float))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, between 0 and 1, to every row of docs; null and empty texts are one empty line.

    Repeated rows score alike, an empty table gives an empty result, a column that is called score is replaced.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.quality(texts.to_pylist()), pa.float64())

    return docs.withColumn("score", score("text"))
