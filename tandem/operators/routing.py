"""Budgeted routing: which items get the costly prediction, and what that is worth.

Positions are computed once, before rows are multiplied by budgets; ties in a score go to the smaller item id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import half_even, utility

from .metrics import auroc
from .ordered import by_value, positions, running

Keys = Sequence[str]
BUDGETS = (0, 5, 10, 20, 40, 60, 80, 100)


def _sized(df: DataFrame, keys: Keys) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("n_items")), list(keys))


def top_budget(df: DataFrame, keys: Keys, score: str, budget: float, item: str = "mol_id") -> DataFrame:
    """`selected`: the best budget percent, halves rounded to even."""
    ranked = positions(_sized(df, keys), keys, score, [item])
    return ranked.withColumn("selected", F.col("position") <= half_even(F.col("n_items") * budget / 100)).drop("n_items")


def top_share(df: DataFrame, keys: Keys, score: str, budget: float, item: str = "mol_id") -> DataFrame:
    """`selected`: the best budget percent, rounded up; NULL scores come last."""
    ranked = positions(_sized(df, keys), keys, score, [item])
    return ranked.withColumn("selected", F.col("position") <= F.ceil(F.col("n_items") * budget / 100)).drop("n_items")


def top_count(df: DataFrame, keys: Keys, score: str, k: int, item: str = "mol_id") -> DataFrame:
    return positions(df, keys, score, [item]).withColumn("selected", F.col("position") <= k)


def top_positive(df: DataFrame, keys: Keys, score: str, budget: float, threshold: float = 0.0, item: str = "mol_id") -> DataFrame:
    """As top_budget, but only scores above the threshold."""
    out = top_budget(df, keys, score, budget, item)
    return out.withColumn("selected", F.col("selected") & F.coalesce(F.col(score) > threshold, F.lit(False)))


def gate_thresholds(train: DataFrame, keys: Keys, score: str, quantile: float) -> DataFrame:
    """The exact quantile of the training scores, by linear interpolation, as `threshold`."""
    return train.groupBy(*keys).agg(F.percentile(score, F.lit(quantile)).alias("threshold"))


def top_gated(df: DataFrame, thresholds: DataFrame, keys: Keys, score: str, budget: float, item: str = "mol_id") -> DataFrame:
    """As top_budget, but only scores at the threshold or above; a group without one abstains."""
    out = top_budget(df, keys, score, budget, item).join(thresholds, list(keys), "left")
    return out.withColumn("selected", F.col("selected") & F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)))


def routed(df: DataFrame, reference: str = "pred2d", alternative: str = "pred3d") -> DataFrame:
    return df.withColumn("routed", F.when(F.col("selected"), F.col(alternative)).otherwise(F.col(reference)))


def routing_curves(
    df: DataFrame, keys: Keys, routers: Mapping[str, Column], budgets: Sequence[int] = BUDGETS, item: str = "mol_id", y: str = "y"
) -> DataFrame:
    """keys (task_type among them), router, budget, call_rate, metric, value and performance.

    Errors need no row for each budget: one pass keeps a sum for each. AUROC needs the routed predictions themselves.
    """
    keys = list(keys)
    names = F.array(*[F.struct(F.lit(n).alias("router"), c.cast("double").alias("route_score")) for n, c in routers.items()])
    rows = df.select(*keys, item, y, "pred2d", "pred3d", F.inline(names))
    rows = positions(_sized(rows, [*keys, "router"]), [*keys, "router"], "route_score", [item])
    cut = lambda b: half_even(F.col("n_items") * b / 100)
    miss = lambda p: F.abs(F.col(y) - F.col(p))
    errors = rows.where("task_type = 'regression'").groupBy(*keys, "router").agg(
        *[F.avg(F.when(F.col("position") <= cut(b), miss("pred3d")).otherwise(miss("pred2d"))).alias(f"v{b}") for b in budgets],
        *[F.avg((F.col("position") <= cut(b)).cast("double")).alias(f"r{b}") for b in budgets],
    )
    points = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"r{b}").alias("call_rate"), F.col(f"v{b}").alias("value")) for b in budgets])
    mae = errors.select(*keys, "router", F.inline(points)).withColumn("metric", F.lit("MAE"))
    cls = rows.where("task_type = 'classification'").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    cls = cls.withColumn("selected", F.col("position") <= half_even(F.col("n_items") * F.col("budget") / 100))
    cls = routed(cls)
    group = [*keys, "router", "budget"]
    rates = cls.groupBy(*group).agg(F.avg(F.col("selected").cast("double")).alias("call_rate"))
    auc = auroc(cls, group, y, "routed").join(rates, group).withColumnRenamed("AUROC", "value").withColumn("metric", F.lit("AUROC"))
    out = mae.unionByName(auc.select(mae.columns))
    return out.withColumn("performance", F.when(F.col("metric") == "AUROC", F.col("value")).otherwise(-F.col("value")))


def with_utilities(df: DataFrame) -> DataFrame:
    return df.withColumn("utility", utility("task_type", "y", "pred2d", "pred3d"))


def uncertainty(df: DataFrame, keys: Keys, reference: DataFrame, p: str = "pred2d") -> DataFrame:
    """1 - max(p, 1 - p) in classification; absolute z against the reference predictions in regression."""
    stats = reference.groupBy(*keys).agg(F.avg(p).alias("_mean"), F.stddev_pop(p).alias("_sd"))
    z = F.abs(F.col(p) - F.col("_mean")) / F.when(F.col("_sd") < 1e-8, 1.0).otherwise(F.col("_sd"))
    out = df.join(stats, list(keys), "left")
    return out.withColumn("uncertainty", F.when(F.col("task_type") == "classification", 1 - F.greatest(F.col(p), 1 - F.col(p))).otherwise(z)).drop("_mean", "_sd")


def standardised(df: DataFrame, keys: Keys, value: str, reference: DataFrame, name: str = "z") -> DataFrame:
    stats = reference.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    sd = F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd"))
    return df.join(stats, list(keys), "left").withColumn(name, (F.col(value) - F.col("_mean")) / sd).drop("_mean", "_sd")


def cost_penalised(df: DataFrame, keys: Keys, gain: str, cost: str, weight: float) -> DataFrame:
    """`penalised`: the gain minus weight times the z score of the cost."""
    out = standardised(df, keys, cost, df, "_z")
    return out.withColumn("penalised", F.col(gain) - weight * F.col("_z")).drop("_z")


def placements(df: DataFrame, keys: Keys, y: str, p: str, against: str, name: str, item: str = "mol_id") -> DataFrame:
    """For each item the share of the other class that `against` places on its wrong side, ties counting one half.

    keys, item and `name`: of a positive, how many negatives lie below it; of a negative, how many positives above.
    """
    keys = list(keys)
    side = F.col(y).cast("int")
    asks = df.select(*keys, side.alias("_side"), item, F.col(p).alias("_x"))
    others = df.select(*keys, (1 - side).alias("_side"), F.col(against).alias("_x"), F.lit(1.0).alias("_ref"))
    values = asks.select(*keys, "_side", "_x").distinct().withColumn("_ref", F.lit(0.0)).unionByName(others)
    table = by_value(values, [*keys, "_side"], "_x", {"_n": F.col("_ref")})
    sizes = df.groupBy(*keys, (1 - side).alias("_side")).agg(F.count("*").cast("double").alias("_m"))
    table = table.join(sizes, [*keys, "_side"])
    below = (F.col("_n_to") - F.col("_n") / 2) / F.col("_m")
    table = table.withColumn(name, F.when(F.col("_side") == 1, below).otherwise(1 - below))
    return asks.join(table.select(*keys, "_side", "_x", name), [*keys, "_side", "_x"], "left").select(*keys, item, name)


def auc_contributions(df: DataFrame, keys: Keys, item: str = "mol_id") -> DataFrame:
    """`contribution`: how an item's placement against the other class's reference scores changes, over its class's size."""
    keys = list(keys)
    new, old = placements(df, keys, "y", "pred3d", "pred2d", "_new", item), placements(df, keys, "y", "pred2d", "pred2d", "_old", item)
    sizes = df.groupBy(*keys, "y").agg(F.count("*").alias("_size"))
    out = df.select(*keys, item, "y").join(new, [*keys, item]).join(old, [*keys, item]).join(sizes, [*keys, "y"])
    return out.select(*keys, item, "y", ((F.col("_new") - F.col("_old")) / F.col("_size")).alias("contribution"))


def task_policies(states: DataFrame) -> DataFrame:
    """One row for each policy: permission from validation evidence only, and the gain on the test side.

    states has validation_gain, relative_validation_gain, lcb, paired_permission and test_gain.
    """
    # fixed values of the protocol: names and cuts
    rules = {
        "Always-2D": F.lit(False),
        "Always-2D+3D": F.lit(True),
        "TaskSelect": F.col("validation_gain") > 0,
        "ThresholdSelect-0.5pct": F.col("relative_validation_gain") > 0.005,
        "ThresholdSelect-1pct": F.col("relative_validation_gain") > 0.01,
        "TaskMetric-LCB": F.col("lcb") > 0,
        "PairedTest-0.025": F.col("paired_permission"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(r, F.lit(False)).alias("permission")) for n, r in rules.items()])
    return states.select("*", F.inline(rows))


def policy_outcomes(policies: DataFrame, gain: str = "test_gain") -> DataFrame:
    """Adds what each decision was worth: policy_gain, decision_correct, whether it was a false activation or rejection, and
    the amounts negative_transfer, missed_gain and regret."""
    on, g = F.col("permission"), F.col(gain)
    mine = F.when(on, g).otherwise(0.0)
    return policies.select(
        "*",
        mine.alias("policy_gain"),
        (on == (g > 0)).alias("decision_correct"),
        (on & (g <= 0)).alias("false_activation"),
        (~on & (g > 0)).alias("false_rejection"),
        F.greatest(F.lit(0.0), -mine).alias("negative_transfer"),
        F.when(~on & (g > 0), g).otherwise(0.0).alias("missed_gain"),
        (F.greatest(g, F.lit(0.0)) - mine).alias("regret"),
    )


def best_expert(df: DataFrame, experts: Sequence[str], abstain: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """`expert`: the first of the highest `score_<expert>`, or none where that is not above the threshold; tasks in
    `abstain` never get one. `expert_score` and `expert_pred` go with it."""
    best = F.greatest(*[F.col(f"score_{e}") for e in experts])
    pick, pred = F.lit(None).cast("string"), F.lit(None).cast("double")
    for e in reversed(experts):
        pick = F.when(F.col(f"score_{e}") == best, e).otherwise(pick)
        pred = F.when(F.col(f"score_{e}") == best, F.col(f"pred_{e}")).otherwise(pred)
    allowed = (best > threshold) & ~F.col("task").isin(*abstain) if abstain else best > threshold
    return df.select("*", F.when(allowed, pick).alias("expert"), F.when(allowed, best).alias("expert_score"), F.when(allowed, pred).alias("expert_pred"))


def placebo(df: DataFrame, keys: Keys, value: str, seed: int, item: str = "mol_id") -> DataFrame:
    """`placebo`: the group's values of another item, dealt out by a hash order of the items.

    Both orders are places by (hash, item) and by item, so the permutation depends on the seed and the items alone.
    """
    key = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(item).cast("string"))), 1, 8), 16, 10)).cast("double")
    one = {"_at": F.lit(1).cast("long")}
    mixed = running(df.withColumn("_key", key), keys, "_key", one, ties=[item]).select(*keys, "_at", F.col(value).alias("placebo"))
    plain = running(df.withColumn("_own", F.col(item).cast("double")), keys, "_own", one, ties=[item])
    return plain.join(mixed, [*keys, "_at"]).drop("_at", "_own")


def noise_penalised(df: DataFrame, keys: Keys, score: str, level: float) -> DataFrame:
    """`penalised`: the score minus level times the group's deviation of it."""
    stats = df.groupBy(*keys).agg(F.stddev_pop(score).alias("_sd"))
    return df.join(stats, list(keys)).withColumn("penalised", F.col(score) - level * F.col("_sd")).drop("_sd")


def support(df: DataFrame, train: DataFrame, keys: Keys, group: str) -> DataFrame:
    """`support`: log1p of how many training items share the group."""
    counts = train.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    return df.join(counts, [*keys, group], "left").withColumn("support", F.log1p(F.coalesce("_n", F.lit(0)).cast("double"))).drop("_n")


def packed_bits(vector: str) -> Column:
    """The signs of an array as 64-bit words."""
    size = F.size(vector)
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / 64).cast("int") - 1))
    bit = lambda w, i: F.when(F.get(vector, w * 64 + i) > 0, F.expr("1L << 0")).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", bit(w, i), i))
    )
    return F.transform(words, word)
