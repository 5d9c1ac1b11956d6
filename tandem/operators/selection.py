"""Choosing routers on held-out evidence: out-of-fold scores, gates, reliability, calibration, candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import half_even

from .metrics import auroc, ndcg
from .ordered import positions, running
from .relational import arg_best
from .routing import BUDGETS, standardised

Keys = Sequence[str]
#: Weights of the risk that are tried; fixed values of the protocol.
RISK_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)


def fold_scores(df: DataFrame, keys: Keys, fold: str, score: str, least: int = 16, share: float = 0.8, median: str | None = None) -> DataFrame:
    """Out-of-fold scores of every group that has enough of them, gaps filled with the group's median.

    The column `median`, if named, has that, which is the median of the filled scores too.

    A fold with fewer than `least` rows outside it was never fitted, so its scores do not count. A group needs two
    folds, max(least, half its rows) scores and the share of them.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys, fold).agg(F.count("*").alias("_own"))
    whole = sizes.groupBy(*keys).agg(F.sum("_own").alias("_n"), F.count_if(F.col(fold) >= 0).alias("_folds"))
    rows = df.join(F.broadcast(sizes.join(whole, keys)), [*keys, fold])
    rows = rows.withColumn("_s", F.when((F.col("_n") - F.col("_own") >= least) & (F.col("_folds") >= 2) & (F.col(fold) >= 0), F.col(score)))
    known = rows.groupBy(*keys).agg(F.count("_s").alias("_known"), F.percentile("_s", F.lit(0.5)).alias("_fill"))
    rows = rows.join(F.broadcast(known), keys).where(F.col("_known") >= F.greatest(F.lit(least), F.floor(F.col("_n") / 2))).where(F.col("_known") >= share * F.col("_n"))
    rows = rows.withColumn(score, F.coalesce("_s", "_fill"))
    return (rows.withColumn(median, F.col("_fill")) if median else rows).drop("_own", "_n", "_folds", "_s", "_known", "_fill")


def gated_performance(df: DataFrame, keys: Keys, score: str, gate: str, budgets: Sequence[int] = BUDGETS, item: str = "mol_id", gates: DataFrame | None = None) -> DataFrame:
    """keys, budget, call_rate and performance when the best budget percent are called that reach the threshold in `gate`.

    Keys hold task_type and whatever tells candidates apart; a NULL gate lets everything pass. With `gates` (keys, names of gates
    and the threshold) every group is ordered once for all its gates, and their names join the keys of the result. A row adds to
    the sums of the least budget that reaches it, and sums of greater budgets follow; only classes are multiplied by budgets.
    """
    keys, budgets = list(keys), sorted(budgets)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = sizes.select(*keys, "_n", F.array(*[half_even(F.col("_n") * b / 100) for b in budgets]).alias("_cuts"))
    rows = positions(df, keys, score, [item], "_at").join(F.broadcast(sizes), keys)
    rows = rows.withColumn("_reach", F.size(F.filter("_cuts", lambda c: c < F.col("_at")))).drop("_cuts")
    if gates is not None:
        rows = rows.join(F.broadcast(gates), keys)
        keys += [c for c in gates.columns if c not in (*keys, gate)]
    passes = F.col(gate).isNull() | (F.col(score) >= F.col(gate))
    # whether a missing score passes is not known: such a row keeps pred2d and has no call rate where the budget reaches it
    rows = rows.withColumn("_open", passes.isNull()).withColumn("_reach", F.when(F.coalesce(passes, F.lit(True)), F.col("_reach")).otherwise(len(budgets)))
    miss = lambda p: F.abs(F.col("y") - F.col(p))
    sums = rows.groupBy(*keys, "_reach", "_open").agg(F.count("*").alias("_rows"), F.count(miss("pred3d")).alias("_known3"), F.sum(miss("pred3d")).alias("_miss3"), F.count(miss("pred2d")).alias("_known2"), F.sum(miss("pred2d")).alias("_miss2"))
    points = sums.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(budgets) - 1))))
    reached = F.col("_reach") <= F.col("_i")
    called = reached & ~F.col("_open")
    either = lambda a, b: F.sum(F.when(called, F.col(a)).otherwise(F.col(b)))
    out = points.groupBy(*keys, F.array(*map(F.lit, budgets))[F.col("_i")].alias("budget")).agg(
        F.try_divide(F.sum(F.when(called, F.col("_rows")).otherwise(0)), F.sum(F.when(called | ~reached, F.col("_rows")))).alias("call_rate"), F.try_divide(either("_miss3", "_miss2"), either("_known3", "_known2")).alias("_mae")
    )
    group = [*keys, "budget"]
    cls = rows.where("task_type = 'classification'").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(budgets) - 1))))
    cls = cls.withColumn("budget", F.array(*map(F.lit, budgets))[F.col("_i")]).withColumn("_p", F.when(called, F.col("pred3d")).otherwise(F.col("pred2d")))
    out = out.join(auroc(cls, group, "y", "_p"), group, "left")
    return out.select(*group, "call_rate", F.when(F.col("task_type") == "classification", F.col("AUROC")).otherwise(-F.col("_mae")).alias("performance"))


def lexicographic_best(df: DataFrame, keys: Keys, first: str, second: str, order: Sequence[str]) -> DataFrame:
    """The row of the highest `first`, then `second`; the first in the order on ties. NULL never wins over a number."""
    low = F.lit(float("-inf"))
    value = F.struct(-F.coalesce(F.col(first), low), -F.coalesce(F.col(second), low))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(value.alias("_v"), *order, F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(*keys, "_best._row.*")


def risk_weight(df: DataFrame, keys: Keys, score: str, risk: str, gain: str, budget: float = 20, weights: Sequence[float] = RISK_WEIGHTS) -> DataFrame:
    """keys, weight and ndcg: the weight of z(risk) against z(score) with the highest NDCG, the first on ties."""
    keys = list(keys)
    z = standardised(standardised(df, keys, score, df, "_zs"), keys, risk, df, "_zr")
    z = z.withColumn("weight", F.explode(F.array(*map(F.lit, weights)))).withColumn("_c", F.col("_zs") - F.col("weight") * F.col("_zr"))
    found = ndcg(z, [*keys, "weight"], "_c", gain, budget)
    return arg_best(found, keys, F.round("ndcg", 10), ["weight"])


def calibration_part(df: DataFrame, keys: Keys, fold: str, seed: str, item: str = "mol_id", least_train: int = 32, least_cal: int = 8) -> DataFrame:
    """`part`: train or cal. The calibration fold is the (seed modulo the number of folds)-th, or the last of fewer than three.

    Where that leaves too few rows on either side, every fifth row in the order of ids calibrates.
    """
    keys = list(keys)
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col(fold) >= 0, F.col(fold)))).alias("_folds"), F.count("*").alias("_n"))
    size = F.size("_folds")
    picked = F.when(size >= 3, F.get("_folds", F.pmod(F.col(seed), size).cast("int"))).when(size > 0, F.get("_folds", size - 1)).otherwise(0)
    rows = df.join(held, keys).withColumn("_cal", F.coalesce(F.col(fold) == picked, F.lit(False)))
    counts = held.join(rows.groupBy(*keys).agg(F.count_if("_cal").alias("_k")), keys)
    few = (F.col("_n") - F.col("_k") < least_train) | (F.col("_k") < least_cal)
    rows = rows.join(F.broadcast(counts.select(*keys, few.alias("_few"))), keys)
    # only groups that lack rows on a side are put in order
    kept = rows.where(~F.col("_few")).withColumn("part", F.when(F.col("_cal"), "cal").otherwise("train"))
    placed = running(rows.where("_few").withColumn("_own", F.col(item).cast("double")), keys, "_own", {"_at": F.lit(1).cast("long")}, ties=[item])
    placed = placed.withColumn("part", F.when((F.col("_at") - 1) % 5 == 0, "cal").otherwise("train"))
    columns = [*df.columns, "part"]
    return kept.select(*columns).unionByName(placed.select(*columns))


def safe_decision(bounds: DataFrame, gain: Column, bound: str = "lcb", n: str = "n", least: int = 8, floor: float = 0.0) -> DataFrame:
    """`decision`: call where out-of-fold gain, the number of selected items and their bound all permit it, else abstain."""
    permit = (gain > 0) & (F.col(n) >= least) & (F.col(bound) > floor)
    return bounds.withColumn("decision", F.when(F.coalesce(permit, F.lit(False)), "call").otherwise("abstain"))


def baseline_aware(final: DataFrame, baselines: DataFrame, metric: str = "metric", least_seeds: int = 5) -> DataFrame:
    """For every task the better of the routed result and its best baseline, by the metric's direction.

    final: task, metric, value, call_rate. baselines: task, method, value, n_seeds; those of too few seeds are not eligible.
    """
    up = lambda m, v: F.when(F.upper(m).isin("AUROC", "AUPRC", "R2"), v).otherwise(-v)
    eligible = baselines.where(F.col("n_seeds") >= least_seeds).join(final.select("task", metric), "task")
    best = arg_best(eligible, ["task"], F.round(up(F.col(metric), F.col("value")), 10), ["method"])
    both = final.join(best.select("task", F.col("method").alias("best_method"), F.col("value").alias("best_value")), "task", "left")
    use = F.coalesce(up(F.col(metric), F.col("best_value")) > up(F.col(metric), F.col("value")), F.lit(False))
    return both.select(
        "task", metric, F.when(use, F.col("best_value")).otherwise(F.col("value")).alias("selected"), F.when(use, F.col("best_method")).otherwise("routed").alias("source"),
        F.when(use, 0.0).otherwise(F.col("call_rate")).alias("call_rate"), F.when(use, "abstain").otherwise("keep").alias("action"),
    )
