"""Evaluation metrics as aggregates over groups; `keys` name the groups.

Rank metrics first count by distinct score, so ties are exact and the ordered part is as small as the scores allow.
Undefined values (one class only, nothing relevant, a zero denominator) are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import half_even, log_loss, ratio

from .ordered import average_ranks, by_value, positions

Keys = Sequence[str]


def errors(df: DataFrame, keys: Keys, y: str = "y", p: str = "pred") -> DataFrame:
    """MAE, RMSE and R2; R2 of a constant target is 1 without errors, else 0."""
    e = F.col(y) - F.col(p)
    total, rest = F.var_pop(y) * F.count(y), F.sum(e * e)
    r2 = F.when(total > 0, 1 - rest / F.when(total > 0, total)).when(rest == 0, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), r2.alias("R2"))


def accuracy_and_log_loss(df: DataFrame, keys: Keys, y: str = "y", p: str = "pred", cut: float = 0.5) -> DataFrame:
    hit = ((F.col(p) >= cut).cast("double") == F.col(y)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("Accuracy"), F.avg(log_loss(y, p)).alias("LogLoss"))


def auroc(df: DataFrame, keys: Keys, y: str = "y", p: str = "pred") -> DataFrame:
    """The probability that a positive outranks a negative, ties counting one half."""
    counts = by_value(df.where(F.col(y).isNotNull()), keys, p, {"_pos": F.col(y).cast("double"), "_neg": 1 - F.col(y).cast("double")})
    won = F.sum(F.col("_pos") * (F.col("_neg_to") - F.col("_neg") / 2))
    return counts.groupBy(*keys).agg(ratio(won, F.sum("_pos") * F.sum("_neg")).alias("AUROC"))


def average_precision(df: DataFrame, keys: Keys, y: str = "y", p: str = "pred") -> DataFrame:
    counts = by_value(df.where(F.col(y).isNotNull()), keys, p, {"_pos": F.col(y).cast("double"), "_n": F.lit(1.0)}, descending=True)
    return counts.groupBy(*keys).agg(ratio(F.sum(F.col("_pos") * F.col("_pos_to") / F.col("_n_to")), F.sum("_pos")).alias("AUPRC"))


def spearman(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over rows where both values are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_ranks(average_ranks(known, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"))


#: nodes and weights of five-point Gauss-Legendre quadrature on [-1, 1]; fixed values
NODES = (-0.9061798459386640, -0.5384693101056831, 0.0, 0.5384693101056831, 0.9061798459386640)
WEIGHTS = (0.2369268850561891, 0.4786286704993665, 0.5688888888888889, 0.4786286704993665, 0.2369268850561891)
TERMS = 64


def _discounts(low: Column, high: Column) -> Column:
    """The sum of 1 / log2(rank + 1) over ranks low to high.

    TERMS ranks are added one by one. A longer run, as of one score shared by millions, is an integral over
    t = ln(rank + 1) with the corrections of the Euler-Maclaurin formula, so no array grows with the ranks.
    """
    last = F.least(high, low + (TERMS - 1))
    head = F.aggregate(F.sequence(low, last), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    a, b, two = (low + TERMS).cast("double"), high.cast("double"), math.log(2)
    start, width = F.log(a + 1), F.log(b + 1) - F.log(a + 1)
    pieces = F.ceil(width / 0.25 + 1).cast("int")
    half = width / pieces / 2
    at = lambda i, x: start + (2 * i + 1 + x) * half
    piece = lambda i: sum((F.exp(at(i, x)) / at(i, x) * w for x, w in zip(NODES, WEIGHTS, strict=True)), F.lit(0.0))
    area = F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0.0), lambda s, i: s + piece(i)) * half * two
    value, slope = (lambda x: two / F.log(x + 1)), (lambda x: -two / ((x + 1) * F.pow(F.log(x + 1), 2)))
    tail = F.when(high >= low + TERMS, area + (value(a) + value(b)) / 2 + (slope(b) - slope(a)) / 12).otherwise(0.0)
    return F.when(high >= low, head + tail).otherwise(0.0)


def ndcg(df: DataFrame, keys: Keys, score: str, gain: str, budget: float, shared: tuple[DataFrame, Keys] | None = None) -> DataFrame:
    """NDCG at max(1, budget percent of the rows); relevance is max(gain, 0), ties share the average relevance.

    Where many groups of df order the same items, `shared` has these items once, and those of the keys that tell them apart, so
    that their ideal order is found once.
    """
    keys = list(keys)
    relevant = lambda df: df.withColumn("_rel", F.greatest(F.col(gain), F.lit(0.0)))
    cuts = lambda df, keys: df.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), half_even(F.count("*") * budget / 100)).alias("_k"))
    rows = relevant(df)
    cut = cuts(rows, keys)
    all_, of = (rows, keys) if shared is None else (relevant(shared[0]), list(shared[1]))
    cut_all = cut if shared is None else cuts(all_, of)
    got = by_value(rows, keys, score, {"_n": F.lit(1).cast("long"), "_sum": F.col("_rel")}, descending=True).join(cut, keys)
    top = lambda n: _discounts(F.col(f"{n}_to") - F.col(n) + 1, F.least(f"{n}_to", "_k"))
    got = got.groupBy(*keys).agg(F.sum(F.col("_sum") / F.col("_n") * top("_n")).alias("_dcg"))
    best = by_value(all_, of, "_rel", {"_n": F.lit(1).cast("long")}, descending=True).join(cut_all, of)
    best = best.groupBy(*of).agg(F.sum(F.col("_rel") * top("_n")).alias("_ideal"))
    return got.join(best, of).select(*keys, ratio("_dcg", "_ideal").alias("ndcg"))


def precision_at_budget(df: DataFrame, keys: Keys, score: str, hit: Column, budget: float, ties: Sequence[str]) -> DataFrame:
    """The share of hits among the max(1, budget percent) rows of highest score."""
    keys = list(keys)
    ranked = positions(df.withColumn("_hit", hit.cast("double")), keys, score, ties)
    cut = df.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), half_even(F.count("*") * budget / 100)).alias("_k"))
    return ranked.join(cut, keys).where("position <= _k").groupBy(*keys).agg(F.avg("_hit").alias("precision"))


def endpoint_metric(df: DataFrame, keys: Keys, y: str = "y", p: str = "pred") -> DataFrame:
    """metric and value by task_type, which must be among the keys: AUROC for classification, MAE for regression."""
    keys = list(keys)
    cls = auroc(df.where("task_type = 'classification'"), keys, y, p).select(*keys, F.lit("AUROC").alias("metric"), F.col("AUROC").alias("value"))
    reg = errors(df.where("task_type = 'regression'"), keys, y, p).select(*keys, F.lit("MAE").alias("metric"), F.col("MAE").alias("value"))
    return cls.unionByName(reg)


def integrated_gain(curves: DataFrame, keys: Keys, value: str = "performance", budget: str = "budget", baseline: bool = True) -> DataFrame:
    """Trapezoid of (value - value at the first budget) over budget / 100; `area` and the first value `p0`.

    With baseline False nothing is subtracted. A curve has a few budgets, so its window is small.
    """
    w = Window.partitionBy(*keys).orderBy(budget)
    first = F.first(value).over(w)
    rows = curves.withColumn("_p0", first).withColumn("_v", F.col(value) - first if baseline else F.col(value))
    step = (F.col(budget) - F.lag(budget).over(w)) / 100 * (F.col("_v") + F.lag("_v").over(w)) / 2
    return rows.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("area"), F.first("_p0").alias("p0"))


def normalised_gain(gains: DataFrame, keys: Keys, router: str = "router", area: str = "area", oracle: str = "oracle") -> DataFrame:
    """area over the absolute area of the group's oracle. A group has a row for each router, so its window is small."""
    top = F.max(F.when(F.col(router) == oracle, F.col(area))).over(Window.partitionBy(*keys))
    return gains.withColumn("oracle_area", top).withColumn("normalised", F.col(area) / (F.abs("oracle_area") + 1e-8))


def risk_benefit(states: DataFrame, keys: Keys, permission: str = "permission", gain: str = "gain") -> DataFrame:
    """What a policy activates, how often wrongly, and which share of gains it keeps and of harm it avoids."""
    on, g = F.col(permission), F.col(gain)
    positive, negative = F.greatest(g, F.lit(0.0)), F.greatest(-g, F.lit(0.0))
    return states.groupBy(*keys).agg(
        F.avg(on.cast("double")).alias("activation"),
        F.avg((on & (g <= 0)).cast("double")).alias("false_activation"),
        F.avg((~on & (g > 0)).cast("double")).alias("false_rejection"),
        ratio(F.sum(F.when(on, positive).otherwise(0.0)), F.sum(positive)).alias("gain_retention"),
        ratio(F.sum(F.when(~on, negative).otherwise(0.0)), F.sum(negative)).alias("harm_avoidance"),
    )


def selection_diagnostics(df: DataFrame, keys: Keys, selected: str, gain: str) -> DataFrame:
    """Of the selected rows: number, harmful and beneficial shares, mean and sum; share of all positive gain captured."""
    on, g = F.col(selected), F.col(gain)
    mine = F.when(on, g)
    positive = F.greatest(g, F.lit(0.0))
    n = F.count_if(on)
    return df.groupBy(*keys).agg(
        n.alias("selected"),
        F.coalesce(ratio(F.count_if(on & (g < 0)), n), F.lit(0.0)).alias("harmful"),
        F.coalesce(ratio(F.count_if(on & (g > 0)), n), F.lit(0.0)).alias("beneficial"),
        F.avg(mine).alias("mean_gain"),
        F.coalesce(F.sum(mine), F.lit(0.0)).alias("sum_gain"),
        ratio(F.sum(F.when(on, positive).otherwise(0.0)), F.sum(positive)).alias("captured"),
    )
