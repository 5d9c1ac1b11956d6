"""Wrangling: distinct rows by rule, summaries, pivots, checked joins, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.scalars import mean_and_spread


def pick_column(df: DataFrame, names: str | Sequence[str]) -> Column:
    """The first of the names that the table has."""
    names = [names] if isinstance(names, str) else list(names)
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise KeyError(f"none of {names} in {df.columns}")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row for each key: the first, or the last, in the order; aggregated, so that no group meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{c}") for c in rest])
    best = df.groupBy(*keys).agg((F.max(row) if last else F.min(row)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row._{c}").alias(c) for c in rest]).select(*df.columns)


def first_known(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: of every column the first value in the order that is not NULL."""
    rest = [c for c in df.columns if c not in keys]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))).getField("_v")
    return df.groupBy(*keys).agg(*[first(c).alias(c) for c in rest])


def mean_map(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Repeated keys to one row with the mean of every value: a table to look keys up in."""
    return df.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])


def head(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in the order, which has to be total for a stable result."""
    return df.orderBy(*order).limit(n)


def arg_best(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str]) -> DataFrame:
    """The row of the highest value in each group, the first in the order on ties; NULL values never win."""
    ranked = df.withColumn("_worst", -value).where(F.col("_worst").isNotNull())
    return first_by(ranked, keys, ["_worst", *order]).drop("_worst")


def summarise(df: DataFrame, keys: Sequence[str], values: Sequence[str], sample: bool = False, count: str = "seed", text: bool = False, keep_null_keys: bool = False) -> DataFrame:
    """Mean and deviation of each value and the number of different `count`; rows with NULL keys go unless kept."""
    spread = F.stddev_samp if sample else F.stddev_pop
    rows = df if keep_null_keys else df.na.drop(subset=list(keys))
    out = rows.groupBy(*keys).agg(
        *[f for v in values for f in (F.avg(v).alias(f"{v}_mean"), spread(v).alias(f"{v}_std"))], F.countDistinct(count).alias(f"n_{count}")
    )
    for v in values if text else ():
        out = out.withColumn(f"{v}_text", mean_and_spread(f"{v}_mean", F.coalesce(f"{v}_std", F.lit(0.0))))
    return out


def nested_mean(df: DataFrame, levels: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Means of means: over the first level's groups, then over the next level's, and so on."""
    for keys in levels:
        df = df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    return df


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(column, list(names)).agg(F.avg(value))


def pivot_count(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str]) -> DataFrame:
    """Counts with a column for each name, 0 where there are none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == n).alias(n) for n in names])


def top_category(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value and its count; the least value on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return arg_best(counts, keys, F.col("n"), [column])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that are not unique; empty where they are."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_one_to_one(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner joins; raises where a key comes twice on any side."""
    out = None
    for t in tables:
        if repeated_keys(t, keys).limit(1).count():
            raise ValueError(f"{list(keys)} is not unique")
        out = t if out is None else out.join(t, list(keys))
    return out


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that raises where a row finds no partner."""
    if df.join(table, list(keys), "left_anti").limit(1).count():
        raise KeyError(f"a row has no {list(keys)} in the table")
    return df.join(table, list(keys))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return not (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """By name; columns that a table lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_constant_policies(curves: DataFrame, keys: Sequence[str], names: Sequence[str], router: str = "router", budget: str = "budget") -> DataFrame:
    """Adds routers that never act: the value at budget 0 for every budget of the group."""
    zero = curves.where(F.col(budget) == 0)
    rest = [c for c in curves.columns if c not in (*keys, router, budget)]
    zero = zero.groupBy(*keys).agg(*[F.min_by(c, router).alias(c) for c in rest])
    budgets = curves.select(*keys, budget).distinct()
    idle = zero.join(budgets, list(keys)).withColumn(router, F.explode(F.array(*map(F.lit, names))))
    return curves.unionByName(idle.withColumn("call_rate", F.lit(0.0)) if "call_rate" in curves.columns else idle)


def ordered_by_map(df: DataFrame, column: str, order: Mapping[str, int], *more: str) -> DataFrame:
    """Sorts by a custom order; values that it lacks come last."""
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(column)], F.lit(999))
    return df.orderBy(place, *more)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
