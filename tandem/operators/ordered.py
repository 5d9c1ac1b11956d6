"""Running sums and ranks within groups of any size.

A plain window puts a whole group into one task. Here a group of many rows is cut into stretches of about equally many
rows; stretches are summed first, and a window over the few sums of a group gives each stretch the total before it. The
window over rows then covers one stretch only. The cuts are quantiles of a sample that is chosen by a hash of the row's
own order, so a long-tailed value is cut evenly, a constant one is cut by its ties, and the cuts come out the same
wherever, and however often, they are computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a stretch, most stretches of a group, sampled rows for each stretch, cuts looked through at once
ROWS, STRETCHES, SAMPLED, STEP = 1 << 17, 4096, 16, 64


def _place(df: DataFrame, by: str, descending: bool, ties: Sequence[str]) -> Column:
    """A struct that rises in the order of the window: NULL last, then the value, then the ties."""
    x, kind = F.col(by), df.schema[by].dataType.simpleString()
    if descending:
        x = F.bitwise_not(x) if kind in ("tinyint", "smallint", "int", "bigint") else -x
    nan = F.isnan(by) if kind in ("double", "float") else F.lit(False)  # highest, so first when descending
    rank = F.when(F.col(by).isNull(), 1).when(nan, -1 if descending else 0).otherwise(0)
    return F.struct(rank.alias("_rank"), x.alias("_x"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)])


def _cuts(df: DataFrame, keys: Sequence[str], place: Column, rows: int, stretches: int) -> DataFrame:
    """keys, `_cuts` and every STEP-th of them as `_coarse`, for groups whose sample fills two stretches or more.

    One row in rows / SAMPLED is drawn by its hash, so a group's window here is that much smaller than the group.
    """
    drawn = F.pmod(F.xxhash64("_place"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLED / rows))
    sample = df.select(*keys, place.alias("_place")).where(drawn).repartition(*keys).distinct()  # one exchange for all that follows
    group = Window.partitionBy(*keys)
    sample = sample.withColumn("_m", F.count("*").over(group)).withColumn("_nth", F.row_number().over(group.orderBy("_place")))
    pieces = F.least(F.lit(stretches), F.floor(F.col("_m") / SAMPLED))
    starts = F.floor((F.col("_nth") - 1) * pieces / F.col("_m")) > F.floor((F.col("_nth") - 2) * pieces / F.col("_m"))
    cuts = sample.where((F.col("_nth") > 1) & starts).groupBy(*keys).agg(F.sort_array(F.collect_list("_place")).alias("_cuts"))
    return cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: (i + 1) % STEP == 0))


def _stretch(place: Column) -> Column:
    """The number of cuts at or before the place: every STEP-th cut is looked at, then the STEP that follow."""
    skipped = F.size(F.filter("_coarse", lambda c: c <= place)) * STEP
    fine = F.filter(F.slice("_cuts", skipped + 1, STEP), lambda c: c <= place)
    return F.when(F.col("_cuts").isNull(), 0).otherwise(skipped + F.size(fine))


def running(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    ties: Sequence[str] = (),
    stretches: int = STRETCHES,
    rows: int = ROWS,
) -> DataFrame:
    """Adds for every name the sum over this row and those before it; NULL values of `by` come last.

    Rows whose keys are NULL are dropped. Equal rows share a sum unless the columns in `ties` tell them apart.
    `by` is a number. Rows that are equal in it and in all ties stay in one stretch.
    """
    keys = list(keys)
    place = _place(df, by, descending, ties)
    if not keys:
        return running(df.withColumn("_one", F.lit(0)), ["_one"], by, sums, descending, ties, stretches, rows).drop("_one")
    cut = df.join(_cuts(df, keys, place, rows, stretches), keys, "left")
    cut = cut.withColumn("_stretch", _stretch(place)).drop("_cuts", "_coarse")
    totals = cut.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_stretch", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    within = Window.partitionBy(*keys, "_stretch").orderBy(first, *ties).rangeBetween(Window.unboundedPreceding, 0)
    if ties:
        within = within.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(totals, [*keys, "_stretch"])
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(within) + F.col(f"_before_{n}"))
    return out.drop("_stretch", *[f"_before_{n}" for n in sums])


def positions(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], name: str = "position") -> DataFrame:
    """The row's place from 1 in descending order of the score, NULL scores last."""
    return running(df, keys, score, {name: F.lit(1).cast("long")}, descending=True, ties=ties)


def by_value(df: DataFrame, keys: Sequence[str], by: str, sums: Mapping[str, Column], descending: bool = False) -> DataFrame:
    """One row for each different value in a group: every sum, and `<name>_to`, its running sum including the value."""
    groups = df.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return running(groups, keys, by, {f"{n}_to": F.col(n) for n in sums}, descending)


def average_ranks(df: DataFrame, keys: Sequence[str], by: str, name: str, share: bool = False) -> DataFrame:
    """Adds the average rank from 1 (ties share it), or that as a share of the group's values."""
    ranks = by_value(df, keys, by, {"_n": F.lit(1).cast("long")})
    rank = F.col("_n_to") - F.col("_n") + (F.col("_n") + 1) / 2
    ranks = ranks.select(*keys, by, rank.alias(name))
    if share:
        counts = df.groupBy(*keys).agg(F.count(by).alias("_count"))
        ranks = ranks.join(counts, list(keys)).withColumn(name, F.col(name) / F.col("_count")).drop("_count")
    return df.join(ranks, [*keys, by], "left")
