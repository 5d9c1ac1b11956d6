"""Language identification by n-gram filters that answer for all languages at once.

Every language has a Bloom filter of its character n-grams; the filters are bit-sliced: slot s of the table is a mask
with a bit for every language, so one lookup (the AND of a few slots) returns all languages that contain an n-gram. A
text is the sum of its n-grams' masks, a popcount for each language. A filter of which a share f of n-grams that it
does not hold is found by chance makes (hits - f * n) / (1 - f) of its hits; the language with most of them is predicted.

Which n-grams a language contains is learnt from all labelled texts, counted where they lie and summed by language and
n-gram: those that are frequent enough in it, and not very much more frequent in another. The former bounds their number by the
reciprocal of the least share, so the table has a proven size however much text there is; its slots are made by a
grouped OR, and only they come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

SIZES = (3, 4, 5)
#: Slots of the table, a power of two, and how many of them an n-gram is looked up in.
SLOTS = 1 << 20
PROBES = 3
#: An n-gram belongs to a language if at least this share of the language's n-grams are it, ...
SHARE = 1 / 100_000
#: ... and at least this share of what its share is where it is most frequent.
CONTRAST = 1 / 8
#: Languages, at most; the most frequent ones are kept.
LANGUAGES = 63
#: Characters that are looked up together.
PIECE = 1 << 18
#: N-grams of one partition that are held before they are sent on.
HELD = 1 << 21
UNKNOWN = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    """For every code point its lower case, if it is a letter, else 0. Made once in a process."""
    if not _codes:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(y) if len(y := x.lower()) == 1 else c
        _codes.append(table)
    return _codes[0]


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and the text that each is of, some PIECE codes at a time; the last 4 codes of a piece only follow the others.

    Every text has a 0 before and after it. A piece of a text repeats 4 codes of the piece before, so no n-gram is lost.
    """
    table, held, of, n = codes(), [], [], 0
    pad, follow = np.zeros(1, np.uint32), max(SIZES) - 1
    for k, text in enumerate(texts):
        text = text or ""
        for a in range(0, len(text), PIECE):
            part = table[np.frombuffer(text[a : a + PIECE + follow].encode("utf-32-le", "surrogatepass"), np.uint32)]
            part = [pad, part] if a == 0 else [table[np.frombuffer(text[a - 1].encode("utf-32-le", "surrogatepass"), np.uint32)], part]
            # what only follows starts no n-gram here, as the next piece starts with it
            last = a + PIECE >= len(text)
            starts = sum(map(len, part)) if last else PIECE
            held += [*part, pad]
            size = sum(map(len, part)) + 1
            mark = np.full(size, k)
            mark[starts:] = -1
            of.append(mark)
            n += size
            if n >= PIECE:
                yield np.concatenate(held), np.concatenate(of)
                held, of, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(of)


def ngrams(code: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and their texts. An n-gram is letters, with a blank before and after them at most."""
    code = code.astype(np.uint64)
    hashes, owners = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = of[:m] >= 0
        for i in range(1, n - 1):
            ok &= code[i : i + m] != 0
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ code[at + i]) * _MIX[0]
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(of[at])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def slots(hashes: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    """The slots of every n-gram, one array for each probe."""
    step = (hashes * _MIX[1]) >> np.uint64(33) | np.uint64(1)
    for i in range(PROBES):
        yield ((hashes >> np.uint64(20)) + np.uint64(i) * step & np.uint64(n_slots - 1)).astype(np.int64)


@dataclass
class Model:
    """languages: the most frequent first; table: a mask for each slot; chance: how much of what it lacks each filter finds."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For every text its n-grams, and for every language how many of them its filter finds."""
        total = np.zeros(len(texts), np.int64)
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        for code, of in pieces(texts):
            hashes, owner = ngrams(code, of)
            if not len(owner):
                continue
            mask = np.bitwise_and.reduce([self.table[s] for s in slots(hashes, len(self.table))])
            first, n = owner.min(), owner.max() - owner.min() + 1
            total[first : first + n] += np.bincount(owner - first, minlength=n)
            for i in range(len(self.languages)):
                found[first : first + n, i] += np.bincount(owner[(mask >> np.uint64(i) & np.uint64(1)).astype(bool)] - first, minlength=n)
        return total, found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the share of the n-grams that the language has, by chance hits corrected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, found = self.hits(texts)
        true = np.maximum(0, found - self.chance * total[:, None]) / (1 - self.chance)
        best = true.argmax(1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(1, total), 0, 1)
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bit, text) to (bit, gram, n), summed over what a partition holds."""
    held: dict[int, list] = {}
    n_held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for bit, parts in held.items():
            grams, n = _summed(parts)
            for a in range(0, len(grams), 1 << 16):
                b = a + (1 << 16)
                yield pa.record_batch({"bit": np.full(len(grams[a:b]), bit, np.int32), "gram": grams[a:b].view(np.int64), "n": n[a:b]})
        held.clear()

    for batch in batches:
        bits, texts = batch["bit"].to_numpy(), batch["text"]
        for bit in np.unique(bits):
            mine = texts.filter(pa.array(bits == bit)).to_pylist()
            for code, of in pieces(mine):
                grams, n = np.unique(ngrams(code, of)[0], return_counts=True)
                parts = held.setdefault(int(bit), [])
                parts.append((grams, n))
                if len(parts) > 8:
                    held[int(bit)] = [_summed(parts)]
            n_held = sum(len(g) for parts in held.values() for g, _ in parts)
            if n_held > HELD:
                yield from out()
    yield from out()


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return grams, n


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from; a row without an id is not among them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, share: float = SHARE, contrast: float = CONTRAST, n_slots: int = SLOTS) -> Model:
    """Learns from every text with a lang outside the held-out fold; without any the model knows no language."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "language-id")
    small_batches(spark)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = [r.lang for r in seen]
    if not languages:
        return Model([], np.zeros(1, np.uint64), np.zeros(0))
    bits = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "bit int, lang string"))
    texts = rows.join(bits, "lang").select("bit", "text")
    grams = texts.mapInArrow(counted, "bit int, gram long, n long").groupBy("gram", "bit").agg(F.sum("n").alias("n"))
    grams = scratch.keep(grams, "grams")
    totals = {r.bit: r.n for r in grams.groupBy("bit").agg(F.sum("n").alias("n")).collect()}
    sizes = F.broadcast(spark.createDataFrame(list(totals.items()), "bit int, total long"))
    rates = grams.join(sizes, "bit").select("gram", "bit", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= share * contrast)
    # all languages of an n-gram in one row; those in which it is too rare to be contained say nothing
    by = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("bit", "rate")).alias("each"))
    by = by.select("gram", "most", F.explode("each").alias("each")).select("gram", "each.bit", "each.rate", "most")
    inside = by.where((F.col("rate") >= share) & (F.col("rate") >= contrast * F.col("most"))).select("gram", F.expr("shiftleft(1L, bit)").alias("mask"))

    @F.arrow_udf("array<int>")
    def where(gram: pa.Array) -> pa.Array:
        found = np.stack(list(slots(gram.to_numpy(zero_copy_only=False).view(np.uint64), n_slots)), axis=1).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, PROBES, dtype=np.int32), found.ravel())

    masks = inside.groupBy("gram").agg(F.bit_or("mask").alias("mask"))
    slot = masks.select(F.explode(where("gram")).alias("slot"), "mask").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(n_slots, np.uint64)
    for r in slot.collect():  # at most n_slots
        table[r.slot] = np.uint64(r.mask)
    scratch.drop("grams")
    fill = np.array([(table >> np.uint64(i) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, np.minimum(0.99, fill**PROBES))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `lang_pred` and `score` (0 to 1) to every row of docs; columns of these names are replaced.

    A text that is null or has no letter is `und` with score 0, as is every text if no language is known. A text with
    letters whose n-grams no language has goes to the most frequent language with score 0. Ties go to the more
    frequent language. Repeated rows get equal results, an empty table an empty one; texts of any length are read
    whole, a piece at a time.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("lang_pred string, score double")
    def look(texts: pa.Array) -> pa.Array:
        names, score = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, look("text").alias("_found")).select(*kept, "_found.*")
