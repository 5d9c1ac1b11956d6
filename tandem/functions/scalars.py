"""Column expressions with the semantics that the metrics need: missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from math import exp, factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGHER_IS_BETTER = ("AUROC", "AUPRC", "Accuracy", "R2")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN becomes NULL, so that aggregates skip it and comparisons are false."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def half_even(c: Column | str) -> Column:
    """Rounds to whole numbers, halves to even."""
    return F.bround(_c(c), 0).cast("long")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def is_close(a: Column | str, b: float, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(_c(a) - F.lit(float(b))) <= absolute + relative * abs(b)


def higher_is_better(metric: Column | str) -> Column:
    return _c(metric).isin(*HIGHER_IS_BETTER)


def signed_gain(metric: Column | str, reference: Column | str, alternative: Column | str) -> Column:
    """Positive where the alternative is better."""
    a, b = _c(reference), _c(alternative)
    return F.when(higher_is_better(metric), b - a).otherwise(a - b)


def performance(metric: Column | str, value: Column | str) -> Column:
    """The value, or minus the value where less is better."""
    return F.when(higher_is_better(metric), _c(value)).otherwise(-_c(value))


def gain_category(metric: Column | str, reference: Column | str, alternative: Column | str, absolute: float = 0.01, relative: float = 0.02) -> Column:
    """helpful, neutral or harmful; the margin is absolute for scores and relative for errors."""
    gain = signed_gain(metric, reference, alternative)
    gain = F.when(higher_is_better(metric), gain / absolute).otherwise(ratio(gain, F.abs(_c(reference))) / relative)
    return F.when(gain >= 1, "helpful").when(gain <= -1, "harmful").when(gain.isNotNull(), "neutral")


def bin_right_closed(c: Column | str, edges: Sequence[float]) -> Column:
    """The number of the bin (edges[i], edges[i + 1]] from 0; NULL outside."""
    c, out = _c(c), F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def mapped(c: Column | str, values: Mapping, default=None) -> Column:
    """Looks c up in a dictionary."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(table[_c(c)], F.lit(default))


def replaced_prefix(c: Column | str, old: str, new: str) -> Column:
    """The text with `new` in place of `old` where it begins with that; anywhere else it stays."""
    c = _c(c)
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 2**31 - 1))).otherwise(c)


def weights_json(names: Column | str, weights: Column | str) -> Column:
    """A JSON object of names and weights, from two arrays."""
    return F.to_json(F.map_from_arrays(_c(names), _c(weights)))


def mean_and_spread(mean: Column | str, spread: Column | str) -> Column:
    return F.format_string("%.6f +/- %.6f", _c(mean), _c(spread))


def stable_offset(c: Column | str, size: int = 100_000) -> Column:
    """A number below `size` from the first eight digits of the MD5."""
    return F.conv(F.substring(F.md5(_c(c)), 1, 8), 16, 10).cast("long") % size


def clipped(p: Column | str, low: float = 1e-6) -> Column:
    """Within [low, 1 - low]; NULL stays NULL."""
    p = _c(p)
    return F.when(p.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(1 - low), p)))


def log_loss(y: Column | str, p: Column | str) -> Column:
    y, p = _c(y), clipped(p)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def item_loss(task_type: Column | str, y: Column | str, p: Column | str) -> Column:
    """Log loss of an item in classification, absolute error in regression."""
    return F.when(_c(task_type) == "classification", log_loss(y, p)).otherwise(F.abs(_c(y) - _c(p)))


def utility(task_type: Column | str, y: Column | str, reference: Column | str, alternative: Column | str) -> Column:
    """How much loss the alternative saves on an item."""
    return item_loss(task_type, y, reference) - item_loss(task_type, y, alternative)


def margin_utility(y: Column | str, reference: Column | str, alternative: Column | str) -> Column:
    return (2 * _c(y) - 1) * (_c(alternative) - _c(reference))


def hashed(row: Column | str, turn: Column | str, seed: int, modulus: Column | str) -> Column:
    """A number below the modulus from two counters: quadratic congruences modulo 2^31 - 1, the same in any SQL."""
    p = 2147483647
    x = (_c(turn) * 48271 + _c(row) * 40692 + seed * 69621 + 12345) % p
    x1 = (x * x + _c(turn)) % p
    x2 = (x1 * 16807 + _c(row)) % p
    return ((x2 * x2 + 1) % p) % _c(modulus)


#: Millionths of the Poisson distribution with mean 1 up to 0, 1, 2, ... events.
POISSON = tuple(int(1e6 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(9))


def poisson_weight(item: Column | str, turn: Column | str, seed: int) -> Column:
    """How often a resample draws an item: a Poisson number of mean 1 from a hash of both, so no row has to know of another."""
    u = hashed(F.pmod(_c(item).cast("long"), F.lit(2147483647)), _c(turn).cast("long"), seed, F.lit(1_000_000))
    return sum(((u >= cut).cast("int") for cut in POISSON[1:]), (u >= POISSON[0]).cast("int"))
