"""A gate in full: does evidence on held-out items permit the costly predictor, and would it also have done so without real costly features?

Three conditions are fitted side by side: the true costly features; none, the alternative differing from the reference by its seed
only; and costly features dealt out to other items of the same split. Reference and alternative are forests, in every fold of
whole groups and once on all training rows, all groups, folds and conditions of a kind together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import clipped, utility
from tandem.sources.tables import written

from .inference import hashed_lcb
from .metrics import endpoint_metric
from .routing import placebo, top_budget, top_share, uncertainty
from .splits import group_folds, hash_key
from .trees import extra_trees

Keys = Sequence[str]
#: How far the alternative's seed is from the reference's; fixed values of the protocol.
CONDITIONS = {"original_true3d": 1000, "seed_null_2d": 1000, "permuted_3d_placebo": 0}
#: The fold that stands for all training rows.
WHOLE = -1


def with_conditions(df: DataFrame, keys: Keys, costly: Sequence[str], seed: int = 340_000) -> DataFrame:
    """Every row once for each condition: its costly features as they are, 0 (which no tree can split), or those of another item of its split."""
    keys = list(keys)
    held = df.withColumn("_block", F.struct(*costly))
    moved = placebo(held, [*keys, "split"], "_block", seed).select(*df.columns, F.col("placebo").alias("_block"))
    parts = [
        df.withColumn("condition", F.lit("original_true3d")),
        df.withColumns({c: F.lit(0.0) for c in costly}).withColumn("condition", F.lit("seed_null_2d")),
        moved.withColumns({c: F.col(f"_block.{c}") for c in costly}).withColumn("condition", F.lit("permuted_3d_placebo")).drop("_block"),
    ]
    return reduce(DataFrame.unionByName, parts)


def usable_folds(df: DataFrame, keys: Keys, group: str, n: int, label: str = "y") -> DataFrame:
    """Training rows with `fold`, whole groups in each and classes even; NULL in a task that cannot be cut into two folds: one of fewer than two
    groups, or of fewer than two rows of a class. There are at most as many folds as groups and as rows of the rarest class."""
    keys, kinds = list(keys), []
    facts = df.groupBy(*keys).agg(F.countDistinct(group).alias("_groups"), F.count_if(F.col(label) == 1).alias("_ones"), F.count_if(F.col(label) == 0).alias("_zeros"))
    few = F.when(F.col("task_type") == "classification", F.least("_groups", "_ones", "_zeros")).otherwise(F.col("_groups"))
    sized = written(df.join(facts.select(*keys, F.least(F.lit(n), few).cast("int").alias("_folds")), keys), "folds")
    # at most n - 1 numbers of folds for each kind of task
    for r in sized.where("_folds >= 2").select("_folds", "task_type").distinct().collect():
        part = sized.where((F.col("_folds") == r._folds) & (F.col("task_type") == r.task_type))
        kinds.append(group_folds(part, keys, group, r._folds, label if r.task_type == "classification" else None))
    kinds.append(sized.where("_folds < 2").withColumn("fold", F.lit(None).cast("int")))
    return written(reduce(DataFrame.unionByName, kinds).drop("_folds"), "folds")


def both_predictions(df: DataFrame, keys: Keys, cheap: Sequence[str], costly: Sequence[str], trees: int = 100, depth: int = 12, seed: int = 0) -> DataFrame:
    """df (split, and fold of its training rows) in every condition, with `ref` and `alt`: out of fold for training rows, from all training rows for others.

    A fold without rows of both classes outside it predicts NULL, as does a training row without a fold.
    """
    keys, features = list(keys), [*cheap, *costly]
    rows = written(with_conditions(df.withColumn("_of", F.when(F.col("split") == "train", F.col("fold")).otherwise(F.lit(WHOLE))), keys, costly), "conditions")
    train = rows.where("split = 'train'")
    # a training row serves the fit of all rows and that of every fold but its own
    last = train.groupBy(*keys).agg(F.coalesce(F.max("fold"), F.lit(-1)).alias("_last"))
    others = F.filter(F.sequence(F.lit(WHOLE), F.col("_last")), lambda k: F.coalesce(k != F.col("fold"), F.lit(True)))
    fit = train.join(last, keys).withColumn("_of", F.explode(others)).drop("_last")
    one = fit.where("task_type = 'classification'").groupBy(*keys, "_of").agg(F.countDistinct("y").alias("_k")).where("_k < 2").drop("_k")
    fit = written(fit.join(one, [*keys, "_of"], "left_anti"), "fit")
    out = None
    for kind, classes in (("classification", [0.0, 1.0]), ("regression", None)):
        part, mine = rows.where(F.col("task_type") == kind), fit.where(F.col("task_type") == kind)
        value = lambda c, classes=classes: F.col(c)[1] if classes else F.col(c)
        ref = extra_trees(mine.where("condition = 'original_true3d'"), [*keys, "_of"], cheap, "y", classes, trees=trees, depth=depth, seed=seed)
        part = ref.predict(part, "ref").withColumn("ref", value("ref"))
        names = {}
        for offset in sorted(set(CONDITIONS.values())):
            of = [c for c, o in CONDITIONS.items() if o == offset]
            alt = extra_trees(mine.where(F.col("condition").isin(of)), [*keys, "_of", "condition"], features, "y", classes, trees=trees, depth=depth, seed=seed + offset)
            part = alt.predict(part, f"alt{offset}").withColumn(f"alt{offset}", value(f"alt{offset}"))
            names |= dict.fromkeys(of, f"alt{offset}")
        alt = reduce(lambda a, c: F.when(F.col("condition") == c, F.col(names[c])).otherwise(a), names, F.lit(None).cast("double"))
        part = part.withColumn("alt", alt).drop(*set(names.values()), "_of")
        out = part if out is None else out.unionByName(part)
    return out


def gate(df: DataFrame, keys: Keys, cheap: Sequence[str], costly: Sequence[str], group: str, folds: int = 5, budget: float = 20, repeats: int = 20, trees: int = 100, depth: int = 12, seed: int = 0) -> DataFrame:
    """keys (task_type among them), condition, policy, repeat, metric, value, gain over the reference, call_rate (percent), n_selected,
    mean_utility, harm (share of selected items that lose) and captured (of all positive utility).

    df has mol_id, split (train, val, test), y, the features and the group. A router learns each item's utility from out-of-fold predictions; the bound of
    what it would select on validation rows permits its use on the test rows. Random policies have `repeats` rows, of the budget and of as
    many calls as the permitted router makes; the others repeat 0.
    """
    keys = list(keys)
    known = df.where(F.col("y").isNotNull())
    train = usable_folds(known.where("split = 'train'"), keys, group, folds)
    rest = known.where("split in ('val', 'test')").withColumn("fold", F.lit(None).cast("int"))
    rows = written(both_predictions(train.unionByName(rest), keys, cheap, costly, trees, depth, seed), "gate")
    by = [*keys, "condition"]
    rows = rows.where(F.col("ref").isNotNull() & F.col("alt").isNotNull()).withColumn("utility", utility("task_type", "y", "ref", "alt"))
    rows = uncertainty(rows, by, rows.where("split = 'train'"), "ref")
    router = extra_trees(rows.where("split = 'train'"), by, [*cheap, "ref", "uncertainty"], "utility", trees=trees, leaf=4, depth=depth, seed=seed)
    scored = written(router.predict(rows.where("split <> 'train'"), "score"), "scored")
    val, test = scored.where("split = 'val'"), scored.where("split = 'test'")
    held = top_share(val, by, "score", budget).where("selected")
    bounds = hashed_lcb(val, by, "utility", "mol_id", 500).select(*by, F.col("mean").alias("_mean"), F.col("lcb").alias("_task"))
    bounds = bounds.join(hashed_lcb(held, by, "utility", "mol_id", 500).select(*by, F.col("lcb").alias("_own")), by, "left")
    test = top_share(test, by, "score", budget).drop("position").withColumnRenamed("selected", "_top")
    test = top_share(test, by, "utility", budget).drop("position").withColumnRenamed("selected", "_best")
    test = written(test.join(bounds, by, "left"), "gate-test")
    yes = lambda c: F.coalesce(c, F.lit(False))
    mine = F.col("_top") & yes(F.col("_own") > 0)
    # fixed values of the protocol: names of the policies
    fixed = {
        "2D_reference": F.lit(False), "100%_alternative": F.lit(True), "TaskSelect": yes(F.col("_mean") > 0), "TaskLCB": yes(F.col("_task") > 0),
        "SimpleUtility": F.col("_top") & yes(F.col("score") > 0), "R9_HoldoutLCB": mine, "Oracle@20": F.col("_best"),
    }
    base = [*by, "mol_id", "y", "ref", "alt", "utility"]
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(0).alias("repeat"), c.alias("selected")) for p, c in fixed.items()])
    chosen = test.select(*base, F.inline(each))
    counts = test.groupBy(*by).agg(F.count_if("_top").alias("_k0"), F.count_if(mine).alias("_k1"))
    turns = test.select(*base, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    for k, policy in enumerate(("Random@20", "Random_call_matched_R9")):
        drawn = turns.withColumn("_h", -hash_key(seed + 7000 + 1000 * k, F.concat_ws("/", "mol_id", "repeat")).cast("double"))
        placed = top_budget(drawn, [*by, "repeat"], "_h", 100).join(counts, by)
        chosen = chosen.unionByName(placed.select(*base, F.lit(policy).alias("policy"), "repeat", (F.col("position") <= F.col(f"_k{k}")).alias("selected")))
    return policy_rows(written(chosen, "chosen"), by)


def policy_rows(chosen: DataFrame, keys: Keys) -> DataFrame:
    """What every policy's selection is worth; chosen has policy, repeat, selected, y, ref, alt and utility."""
    by = [*keys, "policy", "repeat"]
    p = F.when(F.col("selected"), F.col("alt")).otherwise(F.col("ref"))
    rows = chosen.withColumn("pred", F.when(F.col("task_type") == "classification", clipped(p)).otherwise(p))
    scored = endpoint_metric(rows, by)
    start = scored.where("policy = '2D_reference'").select(*keys, F.col("value").alias("_start"))
    on = lambda c: F.when(F.col("selected"), c)
    gained = F.greatest("utility", F.lit(0.0))
    facts = rows.groupBy(*by).agg(
        (100 * F.avg(F.col("selected").cast("double"))).alias("call_rate"), F.count_if("selected").alias("n_selected"), F.coalesce(F.avg(on(F.col("utility"))), F.lit(0.0)).alias("mean_utility"),
        F.coalesce(F.avg(on((F.col("utility") < 0).cast("double"))), F.lit(0.0)).alias("harm"), F.try_divide(F.sum(F.coalesce(on(gained), F.lit(0.0))), F.sum(gained)).alias("captured"),
    )
    out = scored.join(facts, by).join(start, list(keys))
    gain = F.col("value") - F.col("_start")
    return out.withColumn("gain", F.when(F.col("metric") == "AUROC", gain).otherwise(-gain)).drop("_start")
