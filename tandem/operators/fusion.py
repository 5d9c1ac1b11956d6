"""Fusing a cheap and a costly block of features: nine methods from single blocks to stacking, all groups at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import clipped, utility
from tandem.sources.tables import written

from .ensembles import late_fusion_grid
from .linear import balanced_logistic, ridge_cv
from .metrics import accuracy_and_log_loss, auroc, average_precision, errors
from .routing import uncertainty
from .trees import extra_trees

Keys = Sequence[str]
#: What is fitted, and which blocks it may see in training; `dropped` sees every row twice, once without the costly block.
VARIANTS = {"cheap": ((1, 0),), "costly": ((0, 1),), "early": ((1, 1),), "dropped": ((1, 1), (1, 0))}


def variant_rows(df: DataFrame, cheap: Sequence[str], costly: Sequence[str], train: bool) -> DataFrame:
    """Every row once for each variant (`variant`), blocks that the variant may not see set to 0, which no tree can split.

    In training `dropped` has every row twice; elsewhere it sees both blocks.
    """
    seen = [(v, *blocks) for v, all_ in VARIANTS.items() for blocks in (all_ if train else all_[:1])]
    rows = df.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b")) for v, a, b in seen])))
    masked = {c: F.when(F.col(f"_v.{x}") == 1, F.col(c).cast("double")).otherwise(F.lit(0.0)) for x, block in (("a", cheap), ("b", costly)) for c in block}
    return rows.withColumns({"variant": F.col("_v.v"), **masked}).drop("_v")


def block_predictions(train: DataFrame, rows: DataFrame, keys: Keys, cheap: Sequence[str], costly: Sequence[str], trees: int = 100, depth: int = 12, seed: int = 0) -> DataFrame:
    """rows with p_cheap, p_costly, p_early and p_dropped: forests of each variant, all fitted together. Keys hold task_type."""
    keys, features = list(keys), [*cheap, *costly]
    out = None
    for kind in ("classification", "regression"):
        fit = variant_rows(train.where(F.col("task_type") == kind), cheap, costly, True)
        classes = [0.0, 1.0] if kind == "classification" else None
        forest = extra_trees(fit, [*keys, "variant"], features, "y", classes, trees=trees, depth=depth, seed=seed)
        asked = variant_rows(rows.where(F.col("task_type") == kind), cheap, costly, False)
        found = forest.predict(asked, "_p").withColumn("_p", F.col("_p")[1] if classes else F.col("_p"))
        names = list(VARIANTS)
        wide = found.groupBy(*keys, "mol_id").pivot("variant", names).agg(F.max("_p")).withColumnsRenamed({v: f"p_{v}" for v in names})
        out = wide if out is None else out.unionByName(wide)
    return rows.join(out, [*keys, "mol_id"])


def _kinds(df: DataFrame, f) -> DataFrame:
    """f of each kind of task, put together again."""
    return reduce(DataFrame.unionByName, [f(df.where(F.col("task_type") == k), k) for k in ("classification", "regression")])


def stacked(val: DataFrame, rows: DataFrame, keys: Keys, inputs: Sequence[str], name: str) -> DataFrame:
    """Adds `name`: the stacker fitted on validation rows, a balanced logistic model or a ridge by leave-one-out; NULL where there is none."""
    fit = {"classification": balanced_logistic, "regression": ridge_cv}
    return _kinds(rows, lambda part, k: fit[k](val.where(F.col("task_type") == k), keys, inputs).predict(part, name))


def fuse(df: DataFrame, keys: Keys, cheap: Sequence[str], costly: Sequence[str], trees: int = 100, depth: int = 12, seed: int = 0) -> DataFrame:
    """Test rows with one prediction for each method: keys, mol_id, y, the nine methods' columns and `called` of the gate.

    df has task_type among the keys, mol_id, split (train, val, test) and y; weights, the gate and the stacker are chosen on validation
    rows. Features that are missing count as the group's median. A group that lacks a split has no row; where a stacker has no fit (one class) its
    prediction is the weighted early one. Probabilities are kept within 1e-6 of 0 and 1, those of the single forests aside.
    """
    keys = list(keys)
    known = df.where(F.col("y").isNotNull())
    rows = known.where(F.col("split").isin("val", "test"))
    rows = written(block_predictions(known.where("split = 'train'"), rows, keys, cheap, costly, trees, depth, seed), "fusion")
    val = rows.where("split = 'val'")

    def grid(other: str, name: str) -> DataFrame:
        best = late_fusion_grid(val.select(*keys, "mol_id", "y", F.col("p_cheap").alias("pred2d"), F.col(other).alias("pred3d")), keys)
        return best.select(*keys, (F.col("weight_step") / 20).alias(name))

    rows = rows.join(grid("p_costly", "w_late"), keys).join(grid("p_early", "w_early"), keys)
    mixed = lambda a, b, w: F.col(a) * (1 - w) + F.col(b) * w
    rows = rows.withColumn("late_mean", mixed("p_cheap", "p_costly", F.lit(0.5)))
    rows = rows.withColumn("late_weighted", mixed("p_cheap", "p_costly", F.col("w_late"))).withColumn("early_weighted", mixed("p_cheap", "p_early", F.col("w_early")))
    rows = uncertainty(rows, keys, val, "p_cheap").withColumn("apart", F.abs(F.col("p_early") - F.col("p_cheap")))
    rows = written(rows.withColumn("benefit", utility("task_type", "y", "p_cheap", "p_early")), "fusion-inputs")
    val, test = rows.where("split = 'val'"), rows.where("split = 'test'")
    gate = extra_trees(val, keys, [*cheap, "p_cheap", "uncertainty"], "benefit", trees=trees, leaf=4, depth=depth, seed=seed + 1)
    test = gate.predict(test, "gate").withColumn("called", F.coalesce(F.col("gate") > 0, F.lit(False)))
    test = test.withColumn("gated", F.when(F.col("called"), F.col("p_early")).otherwise(F.col("p_cheap")))
    test = stacked(val, test, keys, ["p_cheap", "p_costly", "p_early", "late_mean", "uncertainty", "apart", *cheap], "_stacked")
    test = test.withColumn("stacked", F.coalesce("_stacked", "early_weighted"))
    kept = lambda c: F.when(F.col("task_type") == "classification", clipped(c)).otherwise(F.col(c)).alias(c)
    single = [F.col(f"p_{v}") for v in VARIANTS]
    return test.select(*keys, "mol_id", "y", "called", *single, *[kept(c) for c in ("late_mean", "late_weighted", "early_weighted", "gated", "stacked")])


#: The columns of `fuse` and the methods' names; fixed values of the protocol.
METHODS = {
    "p_cheap": "2d_only",
    "p_costly": "3d_only",
    "p_early": "early_concat_fusion",
    "late_mean": "late_mean_fusion",
    "late_weighted": "late_val_weighted_2d_3d",
    "early_weighted": "late_val_weighted_2d_early",
    "gated": "gated_val_utility_fusion",
    "stacked": "moe_stacking_val_calibrated",
    "p_dropped": "modality_dropout_early_fusion",
}


def fusion_metrics(fused: DataFrame, keys: Keys) -> DataFrame:
    """keys, method, call_rate (in percent, of the gate only) and every metric of the task's kind; the others are NULL."""
    keys = list(keys)
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("pred")) for c, m in METHODS.items()])
    rows = written(fused.select(*keys, "y", "called", F.inline(each)), "fusion-methods")
    group = [*keys, "method"]
    cls, reg = rows.where("task_type = 'classification'"), rows.where("task_type = 'regression'")
    bounded = cls.withColumn("pred", clipped("pred"))
    c = auroc(bounded, group).join(average_precision(bounded, group), group).join(accuracy_and_log_loss(bounded, group), group)
    out = c.unionByName(errors(reg, group), allowMissingColumns=True)
    rate = F.when(F.col("method") == METHODS["gated"], 100 * F.avg(F.col("called").cast("double"))).alias("call_rate")
    return out.join(rows.groupBy(*group).agg(rate), group)


def mixture_weights(members: DataFrame, keys: Keys, rounds: int = 20, item: str = "mol_id") -> DataFrame:
    """keys, member, weight and deviation: an expectation-maximisation of the members' weights, `rounds` rounds from equal ones.

    A member takes a share of each item by its weight and how likely it makes the target: p or 1 - p in classification, the density of a
    normal error of the member's own deviation in regression. Its new weight is its mean share. Every round is one grouped sum; members have
    task_type, member, y and pred, and each item all members of its group.
    """
    keys = list(keys)
    rows = written(members.where(F.col("y").isNotNull() & F.col("pred").isNotNull()).select(*keys, item, "member", "y", "pred"), "members")
    error = (F.col("y") - F.col("pred")) ** 2
    state = rows.groupBy(*keys, "member").agg(F.sqrt(F.avg(error)).alias("deviation"))
    state = state.join(rows.groupBy(*keys).agg((1 / F.countDistinct("member")).alias("weight")), keys)
    for _ in range(rounds):
        state = written(state.select(*keys, "member", "weight", "deviation"), "mixture")
        share = share_of_member(F.col("weight"), F.col("deviation"))
        met = rows.join(state, [*keys, "member"]).withColumn("_own", share)
        whole = met.groupBy(*keys, item).agg(F.sum("_own").alias("_all"))
        met = met.join(whole, [*keys, item]).withColumn("_r", F.try_divide("_own", "_all"))
        state = met.groupBy(*keys, "member").agg(F.avg("_r").alias("weight"), F.sqrt(F.try_divide(F.sum(F.col("_r") * error), F.sum("_r"))).alias("deviation"))
    return state.select(*keys, "member", "weight", "deviation")


def share_of_member(weight: Column, deviation: Column) -> Column:
    """Weight times likelihood, without factors that all members share."""
    p, s = clipped("pred"), F.greatest(deviation, F.lit(1e-9))
    normal = F.exp(-((F.col("y") - F.col("pred")) ** 2) / (2 * s * s)) / s
    return weight * F.when(F.col("task_type") == "classification", F.when(F.col("y") == 1, p).otherwise(1 - p)).otherwise(F.greatest(normal, F.lit(1e-300)))
