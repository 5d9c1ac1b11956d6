"""The registered queries over the given tables. Every float is rounded, so sums in any order compare equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import ensembles, fusion, gate, inference, linear, metrics, nearest, relational, routing, selection, splits, trees
from tandem.operators.routers import OBJECTIVES, out_of_fold_scores
from tandem.sources import cache
from tandem.sources.arrays import ArrayFiles
from tandem.sources.tables import read_table, scratch_path, written
from tandem.streaming import monitor

from .fixtures import CHEAP, COSTLY, experts, fingerprints, items, manifest, members, modalities, paired

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GROUP = ["task", "task_type", "seed"]
DIGITS = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places and never -0.0; integers as 64 bits."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.simpleString()
        out.append((F.round(c, DIGITS) + 0.0).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind == "int" else c)
    return df.select(*out)


def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf).where("split = 'test'")


def routers() -> dict[str, Column]:
    return {"oracle": S.utility("task_type", "y", "pred2d", "pred3d"), "score": F.col("score"), "uncertain": -F.abs(F.col("pred2d") - 0.5)}


def curves(spark: SparkSession, sf: str) -> DataFrame:
    return routing.routing_curves(test_rows(spark, sf), GROUP, routers())


def gains(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.integrated_gain(curves(spark, sf), [*GROUP, "router"])


# --- routing -----------------------------------------------------------------------------------------------------


@query
def big_by_router(spark, sf):
    return rounded(gains(spark, sf))


@query
def routing_curve(spark, sf):
    return rounded(curves(spark, sf).drop("performance"))


@query
def gated_curve(spark, sf):
    """Error of the gated route at every budget, gated at the median of the training scores."""
    p = paired(spark, sf).where("task_type = 'regression'")
    gate = routing.gate_thresholds(p.where("split = 'train'"), ["task", "seed"], "score", 0.5)
    out = []
    for b in routing.BUDGETS:
        r = routing.routed(routing.top_gated(p.where("split = 'test'"), gate, ["task", "seed"], "score", b))
        r = r.groupBy("task", "seed").agg(F.avg(F.abs(F.col("y") - F.col("routed"))).alias("mae"), F.avg(F.col("selected").cast("double")).alias("call_rate"), F.first("threshold").alias("threshold"))
        out.append(r.withColumn("budget", F.lit(b)))
    return rounded(relational.union_all(out))


@query
def positive_topk(spark, sf):
    t = test_rows(spark, sf).withColumn("gain", routers()["oracle"])
    return rounded(metrics.selection_diagnostics(routing.top_positive(t, ["task", "seed"], "gain", 60), ["task", "seed"], "selected", "gain"))


@query
def ceil_topk(spark, sf):
    t = routing.top_share(test_rows(spark, sf), ["task", "seed"], "score", 7)
    return t.where("selected").select("task", "seed", "mol_id", "position").withColumn("seed", F.col("seed").cast("long"))


@query
def fixed_topk(spark, sf):
    t = routing.top_count(test_rows(spark, sf), ["task", "seed"], "score", 12)
    return t.where("selected").select("task", F.col("seed").cast("long").alias("seed"), "mol_id", "position")


@query
def utility_logloss(spark, sf):
    return rounded(routing.with_utilities(test_rows(spark, sf)).select("task", "seed", "mol_id", "utility"))


@query
def utility_margin(spark, sf):
    t = test_rows(spark, sf).where("task_type = 'classification'")
    return rounded(t.select("task", "seed", "mol_id", S.margin_utility("y", "pred2d", "pred3d").alias("margin")))


@query
def utility_auc_contrib(spark, sf):
    t = test_rows(spark, sf).where("task_type = 'classification'")
    return rounded(routing.auc_contributions(t, ["task", "seed"]))


@query
def cost_penalised_utility(spark, sf):
    t = routing.with_utilities(test_rows(spark, sf))
    return rounded(routing.cost_penalised(t, ["task", "seed"], "utility", "cost", 0.1).select("task", "seed", "mol_id", "penalised"))


@query
def uncertainty(spark, sf):
    p = paired(spark, sf)
    u = routing.uncertainty(p.where("split = 'test'"), ["task", "seed"], p.where("split = 'train'"))
    return rounded(u.select("task", "seed", "mol_id", "uncertainty"))


@query
def noise_penalised_route(spark, sf):
    t = routing.noise_penalised(test_rows(spark, sf), ["task", "seed"], "score", 1.5)
    t = routing.top_positive(t, ["task", "seed"], "penalised", 40)
    return rounded(t.groupBy("task", "seed").agg(F.count_if("selected").alias("called"), F.sum(F.when(F.col("selected"), F.col("mol_id"))).alias("ids")))


@query
def placebo_permutation(spark, sf):
    t = routing.placebo(test_rows(spark, sf), ["task", "seed"], "pred3d", 7)
    return rounded(t.select("task", "seed", "mol_id", "placebo"))


@query
def random_policy(spark, sf):
    """A random route at 20 percent: scores are hashes of seed and item."""
    t = test_rows(spark, sf).where("task_type = 'regression'").withColumn("dice", S.hashed(F.col("mol_id"), F.col("seed").cast("long"), 3, F.lit(1_000_003).cast("long")).cast("double"))
    t = routing.routed(routing.top_budget(t, ["task", "seed"], "dice", 20))
    return rounded(t.groupBy("task", "seed").agg(F.avg(F.abs(F.col("y") - F.col("routed"))).alias("mae"), F.count_if("selected").alias("called")))


@query
def expert_argmax(spark, sf):
    e = routing.best_expert(experts(spark, sf), ["rich", "scalar"], abstain=["T_O"])
    return rounded(e.groupBy("task", "seed", "expert").agg(F.count("*").alias("n"), F.avg("expert_score").alias("mean_score"), F.avg("expert_pred").alias("mean_pred")))


@query
def multi_expert_route(spark, sf):
    """The best expert's prediction for the best fifth of items, where it is positive."""
    e = routing.best_expert(experts(spark, sf).where("task_type = 'regression'"), ["rich", "scalar"])
    e = routing.routed(routing.top_positive(e, ["task", "seed"], "expert_score", 20), alternative="expert_pred")
    return rounded(e.groupBy("task", "seed").agg(F.avg(F.abs(F.col("y") - F.col("routed"))).alias("mae"), F.avg(F.col("selected").cast("double")).alias("call_rate")))


@query
def support_features(spark, sf):
    p = paired(spark, sf)
    s = routing.support(p.where("split = 'test' and seed = 0"), p.where("seed = 0 and fold_id < 3"), ["task"], "fold_id")
    return rounded(s.groupBy("task", "fold_id").agg(F.first("support").alias("support"), F.count("*").alias("n")))


@query
def tanimoto_nn(spark, sf):
    f = fingerprints(spark, sf).withColumn("bits", routing.packed_bits("embedding"))
    return rounded(nearest.nearest_tanimoto(f, f.where("vec_id % 10 < 8"), "vec_id", "bits"))


@query
def ood_support(spark, sf):
    """How many training items share a vector's label, and how far its nearest one is."""
    f = fingerprints(spark, sf).withColumn("bits", routing.packed_bits("embedding"))
    return rounded(nearest.support_features(f.where("vec_id % 10 >= 8"), f.where("vec_id % 10 < 8"), "vec_id", "bits", "label"))


# --- metrics -----------------------------------------------------------------------------------------------------


@query
def mae_rmse_r2(spark, sf):
    return rounded(metrics.errors(test_rows(spark, sf), ["task", "seed"], "y", "pred2d"))


@query
def auroc(spark, sf):
    return rounded(metrics.auroc(test_rows(spark, sf).where("task_type = 'classification'"), ["task", "seed"], "y", "pred3d"))


@query
def auprc(spark, sf):
    return rounded(metrics.average_precision(test_rows(spark, sf).where("task_type = 'classification'"), ["task", "seed"], "y", "pred3d"))


@query
def accuracy_logloss(spark, sf):
    return rounded(metrics.accuracy_and_log_loss(test_rows(spark, sf).where("task_type = 'classification'"), ["task", "seed"], "y", "pred2d"))


@query
def ndcg_at_budget(spark, sf):
    t = routing.with_utilities(test_rows(spark, sf)).withColumn("coarse", F.round("score", 2))
    return rounded(metrics.ndcg(t, ["task", "seed"], "coarse", "utility", 20))


@query
def precision_at_budget(spark, sf):
    t = routing.with_utilities(test_rows(spark, sf))
    return rounded(metrics.precision_at_budget(t, ["task", "seed"], "score", F.col("utility") > 0, 20, ["mol_id"]))


@query
def spearman(spark, sf):
    return rounded(metrics.spearman(routing.with_utilities(test_rows(spark, sf)), ["task", "seed"], "score", "utility"))


@query
def per_item_loss(spark, sf):
    t = test_rows(spark, sf)
    return rounded(t.select("task", "seed", "mol_id", S.item_loss("task_type", "y", "pred2d").alias("loss2d"), S.item_loss("task_type", "y", "pred3d").alias("loss3d")))


@query
def text_label_auroc(spark, sf):
    i = items(spark, sf).where("quality is not null").withColumn("n", F.col("n_chars").cast("double"))
    a, b = metrics.auroc(i, ["task"], "quality", "n"), metrics.average_precision(i, ["task"], "quality", "n")
    return rounded(a.join(b, "task"))


@query
def endpoint_gain(spark, sf):
    t = test_rows(spark, sf)
    a, b = metrics.endpoint_metric(t, GROUP, "y", "pred2d"), metrics.endpoint_metric(t, GROUP, "y", "pred3d")
    both = a.withColumnRenamed("value", "ref").join(b.withColumnRenamed("value", "alt"), [*GROUP, "metric"])
    return rounded(both.select("task", "seed", "metric", S.signed_gain("metric", "ref", "alt").alias("gain"), S.gain_category("metric", "ref", "alt").alias("category")))


# --- summaries ---------------------------------------------------------------------------------------------------


@query
def summarize_curves(spark, sf):
    return rounded(relational.summarise(curves(spark, sf), ["task", "router", "budget"], ["value", "call_rate"], text=False))


@query
def macro_task_mean(spark, sf):
    return rounded(relational.nested_mean(gains(spark, sf), [["task", "router"], ["router"]], ["area", "p0"]))


@query
def normalized_big(spark, sf):
    return rounded(metrics.normalised_gain(gains(spark, sf), GROUP).drop("p0"))


@query
def pareto_auc(spark, sf):
    return rounded(metrics.integrated_gain(curves(spark, sf), [*GROUP, "router"], "value", baseline=False))


@query
def oracle_recovery(spark, sf):
    """Share of the oracle's gain at 20 percent that each router gets."""
    at = lambda b: F.max(F.when(S.is_close(F.col("budget").cast("double"), b), F.col("performance")))
    g = curves(spark, sf).groupBy(*GROUP, "router").agg((at(20) - at(0)).alias("gain")).where("gain is not null")
    top = F.max(F.when(F.col("router") == "oracle", F.col("gain"))).over(Window.partitionBy(*GROUP))
    g = g.withColumn("oracle_gain", top)
    return rounded(g.select(*GROUP, "router", "gain", F.when(F.abs("oracle_gain") > 1e-12, F.col("gain") / F.col("oracle_gain")).alias("recovered")))


@query
def never3d_pareto(spark, sf):
    c = relational.with_constant_policies(curves(spark, sf), [*GROUP, "metric"], ["always_abstain", "never_3d"])
    return rounded(c.groupBy("router", "budget").agg(F.avg("performance").alias("performance"), F.count_if(F.col("call_rate") > 0).alias("active"), F.count("*").alias("n")))


@query
def pivot_router(spark, sf):
    return rounded(relational.pivot_mean(gains(spark, sf), ["task", "seed"], "router", ["oracle", "score", "uncertain"], "area"))


@query
def unpivot_router(spark, sf):
    wide = relational.pivot_mean(gains(spark, sf), ["task", "seed"], "router", ["oracle", "score"], "area")
    return rounded(wide.unpivot(["task", "seed"], ["oracle", "score"], "router", "area"))


@query
def best_router(spark, sf):
    """The best router by area at every task and seed, the oracle aside."""
    g = gains(spark, sf).where(~F.lower("router").contains("oracle"))
    return rounded(relational.arg_best(g, ["task", "seed"], F.round("area", 10), ["router"]).select("task", "seed", "router", "area"))


@query
def rank_routers(spark, sf):
    """Routers by mean area within a task, equal means sharing the best rank."""
    g = gains(spark, sf).groupBy("task", "router").agg(F.round(F.avg("area"), 10).alias("area"))
    return rounded(g.withColumn("rank", F.rank().over(Window.partitionBy("task").orderBy(F.desc("area")))))


@query
def safe_decision_pivot(spark, sf):
    s = hashed_bounds(spark, sf).withColumn("decision", F.when(F.coalesce(F.col("lcb") > 0, F.lit(False)), "call").otherwise("abstain"))
    return rounded(relational.pivot_count(s, ["task"], "decision", ["call", "abstain"]))


@query
def risk_coverage(spark, sf):
    t = routing.with_utilities(test_rows(spark, sf))
    out = [
        metrics.selection_diagnostics(routing.top_budget(t, ["task", "seed"], "score", b), ["task", "seed"], "selected", "utility").withColumn("budget", F.lit(b))
        for b in routing.BUDGETS
    ]
    return rounded(relational.union_all(out))


@query
def selected_contrast(spark, sf):
    """Means of features in and out of the best fifth, and how many there are."""
    t = routing.top_budget(test_rows(spark, sf), ["task", "seed"], "score", 20).unpivot(["task", "seed", "selected"], ["y", "pred2d", "cost"], "feature", "value")
    on = F.col("selected")
    return rounded(t.groupBy("task", "feature").agg(F.avg(F.when(on, F.col("value"))).alias("inside"), F.avg(F.when(~on, F.col("value"))).alias("outside"), F.count_if(on).alias("n")))


# --- policies and inference --------------------------------------------------------------------------------------


def hashed_bounds(spark, sf) -> DataFrame:
    v = routing.with_utilities(paired(spark, sf).where("split = 'val'"))
    return inference.hashed_lcb(v, ["task", "seed"], "utility", "mol_id")


def endpoint_gains(rows: DataFrame) -> DataFrame:
    """task, task_type, seed, the reference's metric and the gain of the alternative."""
    a, b = metrics.endpoint_metric(rows, GROUP, "y", "pred2d"), metrics.endpoint_metric(rows, GROUP, "y", "pred3d")
    both = a.withColumnRenamed("value", "ref").join(b.withColumnRenamed("value", "alt"), [*GROUP, "metric"])
    return both.select(*GROUP, "ref", S.signed_gain("metric", "ref", "alt").alias("gain"))


def paired_tests(rows: DataFrame) -> DataFrame:
    """task, seed, p, lower and permission of the paired test that suits the task."""
    saved = F.abs(F.col("y") - F.col("pred2d")) - F.abs(F.col("y") - F.col("pred3d"))
    reg = inference.paired_t(rows.where("task_type = 'regression'"), ["task", "seed"], saved)
    cls = inference.paired_delong(rows.where("task_type = 'classification'"), ["task", "seed"])
    cols = ["task", "seed", "p", "lower", F.col("permission").alias("paired_permission")]
    return reg.select(*cols).unionByName(cls.select(*cols))


def evidence(spark, sf, bounds: DataFrame) -> DataFrame:
    """Endpoint gains on both sides, the paired test and a lower bound for each task and seed."""
    p = paired(spark, sf)
    val, test = p.where("split = 'val'"), p.where("split = 'test'")
    out = endpoint_gains(val).select(*GROUP, F.col("gain").alias("validation_gain"), S.ratio("gain", F.abs("ref")).alias("relative_validation_gain"))
    out = out.join(endpoint_gains(test).select("task", "seed", F.col("gain").alias("test_gain")), ["task", "seed"])
    return out.join(paired_tests(val), ["task", "seed"]).join(bounds.select("task", "seed", "lcb"), ["task", "seed"])


def states(spark, sf) -> DataFrame:
    """Validation evidence and test gain of each task and seed; the bound is the hashed one, of the mean utility."""
    return evidence(spark, sf, hashed_bounds(spark, sf))


@query
def policy_states(spark, sf):
    s = routing.policy_outcomes(routing.task_policies(states(spark, sf)))
    return rounded(s.select("task", "seed", "policy", "permission", "test_gain", "policy_gain", "decision_correct", "false_activation", "false_rejection", "negative_transfer", "missed_gain", "regret"))


@query
def risk_benefit(spark, sf):
    return rounded(metrics.risk_benefit(routing.task_policies(states(spark, sf)), ["policy"], "permission", "test_gain"))


@query
def selector_summary(spark, sf):
    s = routing.policy_outcomes(routing.task_policies(states(spark, sf)))
    return rounded(
        s.groupBy("policy").agg(
            F.avg("policy_gain").alias("mean_gain"), F.stddev_samp("policy_gain").alias("sd_gain"), F.countDistinct("task").alias("tasks"), F.count("*").alias("n"),
            F.sum("regret").alias("regret"), F.min("policy_gain").alias("least"), F.max("policy_gain").alias("most"), F.avg(F.col("decision_correct").cast("double")).alias("correct"),
        )
    )


@query
def selector_split_level(spark, sf):
    """Seed means of each policy and how they compare with Always-2D+3D."""
    s = routing.policy_outcomes(routing.task_policies(states(spark, sf))).groupBy("seed", "policy").agg(F.avg("policy_gain").alias("gain"))
    other = s.where("policy = 'Always-2D+3D'").select("seed", F.col("gain").alias("always"))
    return rounded(s.join(other, "seed").withColumn("won", F.col("gain") > F.col("always")))


@query
def delong_stat(spark, sf):
    t = paired(spark, sf).where("split = 'val' and task_type = 'classification'")
    return rounded(inference.paired_delong(t, ["task", "seed"]).drop("p", "lower"))


@query
def paired_t_stat(spark, sf):
    t = paired(spark, sf).where("split = 'val' and task_type = 'regression'")
    d = F.abs(F.col("y") - F.col("pred2d")) - F.abs(F.col("y") - F.col("pred3d"))
    return rounded(inference.paired_t(t, ["task", "seed"], d).drop("p", "lower"))


@query
def holm_bh(spark, sf):
    """Adjusted pseudo p values, ties among them, in families by supplier nation."""
    s = read_table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", ((F.col("s_suppkey") * 37 % 17).cast("double") / 200).alias("p"))
    return rounded(inference.adjusted(s, ["s_nationkey"], "p", ["s_suppkey"]))


@query
def hashed_bootstrap_lcb(spark, sf):
    return rounded(hashed_bounds(spark, sf))


@query
def hashed_sign_perm(spark, sf):
    t = routing.with_utilities(paired(spark, sf).where("split = 'val'"))
    return rounded(inference.hashed_sign_test(t, ["task", "seed"], "utility", "mol_id"))


@query
def exact_bootstrap_lcb(spark, sf):
    v = paired(spark, sf).where("split = 'val'")
    return rounded(inference.exact_lcb(v, ["task", "seed"]))


@query
def cluster_bootstrap_ci(spark, sf):
    s = routing.policy_outcomes(routing.task_policies(states(spark, sf))).withColumn("right", F.col("decision_correct").cast("double"))
    s = s.withColumn("positive", F.greatest("test_gain", F.lit(0.0))).withColumn("kept", F.when(F.col("permission"), F.col("positive")).otherwise(0.0))
    return rounded(inference.cluster_intervals(s, ["policy"], "seed", ["policy_gain", "regret", "right"], ratios={"gain_retention": ("kept", "positive")}))


@query
def cluster_contrast_ci(spark, sf):
    """Differences of every policy to TaskSelect, clusters drawn together."""
    s = routing.policy_outcomes(routing.task_policies(states(spark, sf))).select("task", "seed", "policy", "policy_gain", "regret")
    other = s.where("policy = 'TaskSelect'").select("task", "seed", F.col("policy_gain").alias("g"), F.col("regret").alias("r"))
    d = s.where("policy <> 'TaskSelect'").join(other, ["task", "seed"])
    d = d.select("policy", "seed", (F.col("policy_gain") - F.col("g")).alias("gain_difference"), (F.col("regret") - F.col("r")).alias("regret_difference"))
    return rounded(inference.cluster_intervals(d, ["policy"], "seed", ["gain_difference", "regret_difference"]))


@query
def taskmetric_replay(spark, sf):
    """The decision table with the exact bootstrap of the endpoint gain: 5,000 resamples, seeds from 44,000."""
    exact = inference.exact_lcb(paired(spark, sf).where("split = 'val'"), ["task", "seed"])
    s = routing.policy_outcomes(routing.task_policies(evidence(spark, sf, exact)))
    return rounded(s.select("task", "seed", "policy", "permission", F.col("test_gain").alias("gain"), "policy_gain", F.col("lcb").alias("validation_lcb"), F.col("p").alias("pvalue")))


@query
def paired_test_decisions(spark, sf):
    """Permission of the paired tests and how often it agrees with the bound's."""
    s = states(spark, sf).withColumn("bound", F.coalesce(F.col("lcb") > 0, F.lit(False)))
    return rounded(s.groupBy("task").agg(F.count_if("paired_permission").alias("permitted"), F.avg((F.col("paired_permission") == F.col("bound")).cast("double")).alias("agreement"), F.count("*").alias("n")))


@query
def lcb_alpha_sweep(spark, sf):
    """Bounds of the selected items' mean utility at four levels, and whether they would permit."""
    t = routing.top_budget(routing.with_utilities(test_rows(spark, sf)), ["task", "seed"], "score", 20).where("selected")
    levels = {"a010": 0.01, "a025": 0.025, "a050": 0.05, "a100": 0.1}
    b = inference.hashed_quantiles(t, ["task", "seed"], "utility", "mol_id", levels, repeats=2000, least=1)
    rows = F.array(*[F.struct(F.lit(v).alias("alpha"), F.col(k).alias("lcb")) for k, v in levels.items()])
    out = b.select("task", "seed", "n", "mean", F.inline(rows))
    return rounded(out.withColumn("permit", F.col("lcb") > 0).withColumn("false_safe", (F.col("lcb") > 0) & (F.col("mean") <= 0)))


@query
def utility_lcb_permission(spark, sf):
    """Call or abstain on the bound of the utility of what would be selected on the validation side."""
    v = routing.top_budget(routing.with_utilities(paired(spark, sf).where("split = 'val'")), ["task", "seed"], "score", 20).where("selected")
    b = inference.hashed_lcb(v, ["task", "seed"], "utility", "mol_id", repeats=500)
    return rounded(selection.safe_decision(b, F.col("mean")))


@query
def paired_delta_ci(spark, sf):
    """Interval of the area difference between two routers over all pairs of task and seed."""
    g = relational.pivot_mean(gains(spark, sf), ["task", "seed"], "router", ["score", "uncertain"], "area")
    g = g.withColumn("delta", F.col("score") - F.col("uncertain")).withColumn("contrast", F.lit("score-uncertain"))
    g = g.withColumn("pair", F.ascii(F.substring("task", 3, 1)) * 10 + F.col("seed"))
    return rounded(inference.hashed_quantiles(g, ["contrast"], "delta", "pair", {"low": 0.025, "high": 0.975}))


@query
def hierarchical_gain_ci(spark, sf):
    return rounded(inference.hierarchical_interval(paired(spark, sf).where("split = 'test'"), ["task_type"], ["task", "seed"], repeats=1000))


@query
def label_permutation_null(spark, sf):
    t = routing.top_budget(routing.with_utilities(test_rows(spark, sf)), ["task", "seed"], "score", 20)
    return rounded(inference.permutation_null(t, ["task", "seed"], "selected", "utility"))


@query
def random_budget_control(spark, sf):
    return rounded(inference.random_budget_gain(test_rows(spark, sf), GROUP, 20))


@query
def oof_fold_scores(spark, sf):
    """Out-of-fold scores, one fold in part unknown, filled by the rules."""
    v = paired(spark, sf).where("split = 'train'").withColumn("score", F.when((F.col("fold_id") != 2) | (F.col("mol_id") % 4 == 0), F.col("score")))
    s = selection.fold_scores(v, ["task", "seed"], "fold_id", "score")
    return rounded(s.groupBy("task", "seed").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("least")))


@query
def oof_router_selection(spark, sf):
    """The candidate and gate of highest area, then NDCG, on the validation side; the first wins ties."""
    v = routing.with_utilities(paired(spark, sf).where("split = 'val'"))
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("candidate"), c.alias("s")) for i, (n, c) in enumerate((("score", F.col("score")), ("cheap", -F.col("cost")), ("shift", F.abs(F.col("pred3d") - F.col("pred2d")))))])
    rows = v.select(*GROUP, "mol_id", "y", "pred2d", "pred3d", "utility", F.inline(names))
    best = [*GROUP, "place", "candidate"]
    gates = rows.groupBy(*best).agg(F.percentile("s", F.lit(0.5)).alias("half"))
    gates = gates.select(*best, F.inline(F.array(F.struct(F.lit(0).alias("gate"), F.lit(None).cast("double").alias("threshold")), F.struct(F.lit(1).alias("gate"), F.col("half").alias("threshold")))))
    curve = selection.gated_performance(rows, best, "s", "threshold", gates=gates)
    big = metrics.integrated_gain(curve, [*best, "gate"]).select(*best, "gate", F.round("area", 10).alias("big"))
    n = metrics.ndcg(rows, best, "s", "utility", 20).withColumn("ndcg", F.round("ndcg", 10))
    return rounded(selection.lexicographic_best(big.join(n, best), GROUP, "big", "ndcg", ["place", "gate"]).select("task", "seed", "candidate", "gate", "big", "ndcg"))


@query
def risk_weight_grid(spark, sf):
    """The weight of the risk against the score with the best NDCG."""
    v = routing.with_utilities(paired(spark, sf).where("split = 'val'"))
    return rounded(selection.risk_weight(v, ["task", "seed"], "score", "cost", "utility"))


@query
def nested_calibration(spark, sf):
    """Calibration parts, thresholds from the training part, and what the calibration part would call."""
    v = selection.calibration_part(routing.with_utilities(paired(spark, sf).where("split = 'train'")), ["task", "seed"], "fold_id", "seed")
    gate = routing.gate_thresholds(v.where("part = 'train'"), ["task", "seed"], "score", 0.5)
    c = routing.top_gated(v.where("part = 'cal'"), gate, ["task", "seed"], "score", 60)
    return rounded(c.groupBy("task", "seed").agg(F.count("*").alias("n"), F.count_if("selected").alias("called"), F.avg(F.when(F.col("selected"), F.col("utility"))).alias("mean"), F.first("threshold").alias("threshold")))


@query
def guardrail_route(spark, sf):
    """The gated route where the task may call, a threshold above everything where it abstains."""
    t = routing.with_utilities(test_rows(spark, sf))
    decided = selection.safe_decision(hashed_bounds(spark, sf), F.col("mean")).select("task", "seed", F.when(F.col("decision") == "call", 0.3).otherwise(float("inf")).alias("threshold"))
    g = routing.top_gated(t, decided, ["task", "seed"], "score", 20)
    return rounded(g.groupBy("task", "seed").agg(F.count_if("selected").alias("called"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("utility"))), F.lit(0.0)).alias("gain")))


@query
def gate1_policies(spark, sf):
    """Utility for each item under policies that call none, all, by a task's validation mean or bound, or by score."""
    t = routing.with_utilities(test_rows(spark, sf)).withColumn("centred", F.col("score") - 0.5)
    t = routing.top_budget(t, ["task", "seed"], "centred", 20).drop("position").withColumnRenamed("selected", "top")
    t = routing.top_budget(t, ["task", "seed"], "utility", 20).drop("position").withColumnRenamed("selected", "best")
    t = t.join(hashed_bounds(spark, sf).select("task", "seed", "mean", "lcb"), ["task", "seed"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "reference": F.lit(False), "alternative": F.lit(True), "TaskSelect": yes(F.col("mean") > 0), "TaskLCB": yes(F.col("lcb") > 0),
        "SimpleUtility": F.col("top") & (F.col("centred") > 0), "HoldoutLCB": F.col("top") & yes(F.col("lcb") > 0), "Oracle@20": F.col("best") & (F.col("utility") > 0),
    }
    rows = t.select("task", "seed", "utility", F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("on")) for k, v in rules.items()])))
    return rounded(rows.groupBy("task", "seed", "policy").agg(F.avg(F.when(F.col("on"), F.col("utility")).otherwise(0.0)).alias("gain"), F.avg(F.col("on").cast("double")).alias("call_rate")))


@query
def baseline_aware_candidate(spark, sf):
    """The routed result at 20 percent against both fixed predictors, by the metric's direction."""
    c = curves(spark, sf)
    final = c.where("router = 'score' and budget = 20").groupBy("task", "metric").agg(F.avg("value").alias("value"), F.avg("call_rate").alias("call_rate"))
    ends = c.where("router = 'score' and budget in (0, 100)").withColumn("method", F.when(F.col("budget") == 0, "cheap").otherwise("costly"))
    return rounded(selection.baseline_aware(final, ends.groupBy("task", "method").agg(F.avg("value").alias("value"), F.countDistinct("seed").alias("n_seeds"))))


@query
def budget_rounding_audit(spark, sf):
    """What each budget asks for and what whole items make of it."""
    t = test_rows(spark, sf).groupBy("task", "seed").agg(F.count("*").alias("n")).withColumn("budget", F.explode(F.array(*map(F.lit, routing.BUDGETS))))
    called = S.half_even(F.col("n") * F.col("budget") / 100)
    t = t.withColumn("called", called.cast("long")).withColumn("rounded_up", F.ceil(F.col("n") * F.col("budget") / 100).cast("long"))
    return rounded(t.withColumn("call_rate", F.col("called") / F.col("n")).withColumn("excess", F.col("called") / F.col("n") - F.col("budget") / 100))


@query
def feature_spearman(spark, sf):
    """Rank correlation of every feature with the utility."""
    t = routing.with_utilities(test_rows(spark, sf)).unpivot(["task", "utility"], ["y", "pred2d", "cost", "score"], "feature", "value")
    return rounded(metrics.spearman(t, ["task", "feature"], "value", "utility"))


@query
def conformer_control(spark, sf):
    """Few against many conformers: paired by item, mean difference and share of items that gain."""
    m = manifest(spark, sf).where("energy_min is not null")
    one = m.where("success").select("task", "mol_id", F.col("energy_min").alias("few"))
    ten = m.where("success and rotatable < 9").select("task", "mol_id", (F.col("energy_min") - F.col("rotatable") / 10).alias("many"))
    j = relational.join_one_to_one([one, ten], ["task", "mol_id"])
    d = F.col("few") - F.col("many")
    return rounded(j.groupBy("task").agg(F.count("*").alias("n"), F.avg(d).alias("difference"), F.avg((d > 0).cast("double")).alias("gained")))


@query
def stratified_bootstrap_ci(spark, sf):
    g = relational.pivot_mean(gains(spark, sf), ["task", "seed"], "router", ["oracle", "score"], "area").withColumn("delta", F.col("oracle") - F.col("score"))
    return rounded(inference.two_level_interval(g.withColumn("contrast", F.lit("oracle-score")), ["contrast"], "task", "delta"))


# --- splits ------------------------------------------------------------------------------------------------------


@query
def group_disjoint_check(spark, sf):
    p = paired(spark, sf).where("seed = 0")
    return p.groupBy("task", "group_key").agg(F.countDistinct("split").alias("parts")).groupBy("task").agg(F.max("parts").alias("most"), F.count("*").alias("groups"))


@query
def hashed_random_split(spark, sf):
    s = splits.random_split(paired(spark, sf).where("seed = 0").drop("split"), ["task"], 11)
    return s.groupBy("task", "split").agg(F.count("*").alias("n"), F.sum("mol_id").alias("ids"))


@query
def label_fraction_sample(spark, sf):
    p = paired(spark, sf).where("seed = 0 and task_type = 'classification'")
    s = splits.label_fraction(p, ["task"], "y", 0.25, 5)
    return s.groupBy("task", "y").agg(F.count("*").alias("n"), F.sum("mol_id").alias("ids"))


@query
def hashed_folds(spark, sf):
    p = paired(spark, sf).where("seed = 0 and task_type = 'classification'")
    return rounded(splits.folds(p, ["task"], 5, 1701, label="y").groupBy("task", "y", "fold").agg(F.count("*").alias("n"), F.sum("mol_id").alias("ids")))


@query
def scaffold_greedy_split(spark, sf):
    s = splits.group_split(paired(spark, sf).where("seed = 0"), ["task"], "group_key")
    return s.groupBy("task", "split").agg(F.count("*").alias("n"), F.countDistinct("group_key").alias("groups"))


@query
def scaffold_stratified_split(spark, sf):
    p = splits.quantile_strata(paired(spark, sf).where("seed = 0 and task_type = 'regression'"), ["task"], "y", 5)
    s = splits.group_split(p, ["task"], "group_key", "stratified", seed=3, strata="stratum")
    return s.groupBy("task", "split").agg(F.count("*").alias("n"))


@query
def qcut_strata(spark, sf):
    p = splits.quantile_strata(paired(spark, sf).where("seed = 0 and task_type = 'regression'"), ["task"], "y", 5)
    return rounded(p.groupBy("task", "stratum").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")))


@query
def dataset_card(spark, sf):
    return rounded(splits.dataset_card(paired(spark, sf).where("seed = 0"), ["task", "task_type"]))


@query
def subsample_exact(spark, sf):
    p = splits.subsample(paired(spark, sf).where("seed = 0"), ["task"], 40, 9)
    return p.groupBy("task").agg(F.count("*").alias("n"), F.sum("mol_id").alias("ids"))


@query
def scaffold_balanced_split(spark, sf):
    p = paired(spark, sf).where("seed = 0 and task_type = 'classification'")
    s = splits.group_split(p, ["task"], "group_key", "balanced", seed=4, positive=F.col("y") > 0)
    return rounded(s.groupBy("task", "split").agg(F.count("*").alias("n"), F.sum("y").alias("positives")))


# --- wrangling ---------------------------------------------------------------------------------------------------


@query
def clean_dedup(spark, sf):
    """The first item of every different text, numbered by task."""
    from tandem.operators.ordered import running

    i = items(spark, sf).where("text is not null").withColumn("key", F.md5("text"))
    first = relational.first_by(i.select("key", "mol_id", "task", "n_chars"), ["key"], ["mol_id"]).withColumn("at", F.col("mol_id").cast("double"))
    n = running(first, ["task"], "at", {"n": F.lit(1).cast("long")}, ties=["mol_id"])
    return n.select("mol_id", "n_chars", F.concat_ws("_", "task", F.lpad((F.col("n") - 1).cast("string"), 6, "0")).alias("name"))


@query
def first_known_values(spark, sf):
    """Of every customer's orders the first value of each column that is known."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return rounded(relational.first_known(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "price", "status"))


@query
def duplicate_key_means(spark, sf):
    """Repeated keys averaged to a map, and looked up from another table without a miss."""
    p = read_table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    found = relational.lookup(read_table(spark, sf, "part").select("p_partkey", "p_brand"), relational.mean_map(p, "p_brand", ["size", "price"]), ["p_brand"])
    return rounded(found.groupBy("p_brand").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("price").alias("price")))


@query
def head_rows(spark, sf):
    return rounded(relational.head(test_rows(spark, sf).select("task", "seed", "mol_id", "score"), 12, [F.desc("score"), F.col("mol_id"), F.col("seed")]))


@query
def prefix_and_json(spark, sf):
    """Router names without their prefix, and an ensemble's weights as JSON."""
    c = read_table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    name = S.replaced_prefix(F.concat(F.lit("R8_"), F.lower("c_mktsegment")), "R8_", "")
    return c.select(name.alias("name"), S.replaced_prefix("c_mktsegment", "B", "b-").alias("other"), S.weights_json(F.array(name, F.lit("all")), F.array("n", F.lit(1).cast("long"))).alias("weights"))


@query
def multi_csv_concat(spark, sf):
    """Two CSV files with headers, written and read back as one table."""
    from tandem.sources.tables import read_csv, write_table

    out = scratch_path(spark, "csv")
    for part, t in (("a", "n_nationkey < 10"), ("b", "n_nationkey >= 10")):
        write_table(read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").where(t), f"{out}/{part}", kind="csv")
    return rounded(read_csv(spark, [f"{out}/a", f"{out}/b"], "n_nationkey long, n_name string, n_regionkey long"))


@query
def flexibility_score(spark, sf):
    m = manifest(spark, sf).withColumn("flexibility", F.col("rotatable") + 0.05 * F.length("task"))
    return rounded(m.groupBy("task").agg(F.sum("flexibility").alias("flexibility"), F.count("*").alias("n")))


@query
def column_fallback(spark, sf):
    p = read_table(spark, sf, "part")
    picked = p.select(relational.pick_column(p, ("mol", "p_name")).alias("item"), relational.pick_column(p, ["p_size"]).cast("long").alias("target"))
    return picked.groupBy("item").agg(F.sum("target").alias("target"))


@query
def union_by_name(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = relational.union_all([c, s])
    return rounded(u.groupBy("nation").agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("segments"), F.sum("balance").alias("balance")))


@query
def left_join_desc(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    j = lines.join(p.where("p_size < 25"), "l_partkey", "left")
    return rounded(j.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query
def one_to_one_join(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    return rounded(relational.join_one_to_one([c, s], ["key"]))


@query
def anti_join_missing(spark, sf):
    """Customers without an urgent order."""
    o = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_anti")


@query
def duplicate_keys(spark, sf):
    return relational.repeated_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query
def keep_last(spark, sf):
    """The last order of every customer."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rounded(relational.first_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).drop("o_orderdate"))


@query
def null_key_groups(spark, sf):
    """Group sizes with the missing reason kept, and how many groups there are without it."""
    m = manifest(spark, sf)
    kept = m.groupBy("failure_reason").agg(F.count("*").alias("n"))
    return kept.withColumn("dropped", F.col("failure_reason").isNull())


@query
def rotatable_bins(spark, sf):
    m = manifest(spark, sf).withColumn("bin", S.bin_right_closed(F.col("rotatable").cast("double"), (-0.1, 0, 2, 5, 8, 99)))
    return rounded(m.groupBy("task", "bin").agg(F.count("*").alias("n"), F.avg("elapsed_sec").alias("elapsed")))


@query
def category_screen(spark, sf):
    """Help or harm of a brand's discount against its tax, as two error metrics and as two scores."""
    li = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    g = li.groupBy("p_brand").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    g = g.select("p_brand", "a", "b", F.explode(F.array(F.lit("MAE"), F.lit("AUROC"))).alias("metric"))
    return rounded(g.select("p_brand", "metric", S.signed_gain("metric", "a", "b").alias("gain"), S.gain_category("metric", "a", "b").alias("category")))


@query
def md5_offset(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", S.stable_offset("p_name").alias("offset"))


@query
def value_counts_top(spark, sf):
    return relational.top_category(manifest(spark, sf), ["task"], "failure_reason")


@query
def dict_map_default(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("kind", S.mapped("o_orderstatus", {"F": "finished", "O": "open"}, "other"))
    return o.groupBy("kind").agg(F.count("*").alias("n"))


@query
def coerce_numeric(spark, sf):
    p = read_table(spark, sf, "part").select(F.regexp_extract("p_brand", "[0-9A-Z]+$", 0).alias("s"))
    p = p.withColumn("number", F.col("s").try_cast("double"))
    return rounded(p.groupBy("s").agg(F.max("number").alias("number"), F.count("*").alias("n")))


@query
def task_type_inference(spark, sf):
    p = paired(spark, sf).where("seed = 0")
    return p.groupBy("task").agg(F.when(F.bool_and(F.col("y").isin(0.0, 1.0)), "classification").otherwise("regression").alias("kind"))


@query
def conformer_qc(spark, sf):
    m = manifest(spark, sf)
    qc = m.groupBy("task").agg(
        F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success"), F.avg(F.col("energy_min").isNull().cast("double")).alias("missing"),
        F.percentile("elapsed_sec", F.lit(0.95)).alias("p95"),
    )
    top = relational.top_category(m, ["task"], "failure_reason").select("task", F.col("failure_reason").alias("top_failure"))
    return rounded(qc.join(top, "task", "left").withColumn("passes", F.col("success") >= 0.95))


@query
def cost_rollup(spark, sf):
    m = manifest(spark, sf)
    c = m.groupBy("task").agg(F.avg("elapsed_sec").alias("mean_elapsed"), F.count("*").alias("n"), F.count_if("success").alias("selected"))
    return rounded(c.withColumn("cpu_hours", F.col("selected") * F.col("mean_elapsed") / 3600))


@query
def pct_rank(spark, sf):
    from tandem.operators.ordered import average_ranks

    t = average_ranks(test_rows(spark, sf).where("seed = 0").withColumn("coarse", F.round("score", 2)), ["task"], "coarse", "share", share=True)
    return rounded(t.select("task", "mol_id", "share"))


@query
def zscore(spark, sf):
    p = paired(spark, sf).where("seed = 0")
    z = routing.standardised(p.where("split = 'test'"), ["task"], "score", p.where("split = 'train'"))
    return rounded(z.select("task", "mol_id", "z"))


@query
def stratified_group_folds(spark, sf):
    """Sizes of folds of whole customers, classes kept even where the task has them."""
    t = paired(spark, sf).where("split = 'train'")
    cls = splits.group_folds(t.where("task_type = 'classification'").drop("fold_id"), ["task", "seed"], "group_key", 5, "y")
    reg = splits.group_folds(t.where("task_type = 'regression'").drop("fold_id"), ["task", "seed"], "group_key", 5)
    per = cls.unionByName(reg).groupBy("task", "seed", "fold").agg(F.count("*").alias("n"), F.countDistinct("group_key").alias("groups"), F.avg(F.when(F.col("task_type") == "classification", F.col("y"))).alias("share"))
    return rounded(per)


@query
def array_files(spark, sf):
    """Vectors as array files and back: the sum of each, found by its id in front."""
    spark.dataSource.register(ArrayFiles)
    path = scratch_path(spark, "arrays")
    e = fingerprints(spark, sf).where("embedding is not null")
    numbers = F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))
    e.select(numbers.alias("values")).write.format("arrays").mode("append").save(path)
    back = spark.read.format("arrays").load(path)
    total = F.aggregate(F.slice("values", 2, 1 << 20), F.lit(0.0), lambda a, x: a + x)
    return rounded(back.select(F.col("values")[0].cast("long").alias("vec_id"), total.alias("total"), (F.size("values") - 1).cast("long").alias("n")))


@query
def feature_cache(spark, sf):
    """Features of all texts, computed and put into a cache, then read from it by a second run that may not compute."""
    path, d = scratch_path(spark, "cache"), read_table(spark, sf, "documents").select("doc_id", "text")

    def compute(rows):
        words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
        return rows.select("_key", F.length("text").cast("long").alias("size"), F.when(F.col("text").isNotNull(), words).cast("long").alias("n_words"))

    def refuse(rows):
        raise ValueError("everything is in the cache")

    cache.cached(d, "doc_id", ["text"], compute, path, {"words": 1})
    return rounded(cache.cached(d, "doc_id", ["text"], refuse, path, {"words": 1}).drop("text"))


# --- ensembles ---------------------------------------------------------------------------------------------------


@query
def weighted_average(spark, sf):
    w = spark.createDataFrame([(f"T_{s}", k, n, x) for s in "FOP" for k in range(5) for n, x in (("a2d", 1.0), ("b3d", 3.0))], "task string, seed int, member string, weight double")
    return rounded(ensembles.weighted_average(members(spark, sf), w, ["task", "seed"]))


@query
def late_fusion_grid(spark, sf):
    return rounded(ensembles.late_fusion_grid(paired(spark, sf).where("split = 'val' and task_type = 'regression'"), GROUP))


@query
def best_single(spark, sf):
    return rounded(ensembles.best_single(members(spark, sf), GROUP).select("task", "seed", "member", "metric", "value"))


@query
def greedy_ensemble(spark, sf):
    return rounded(ensembles.greedy_ensemble(members(spark, sf), ["task", "seed"]))


# --- models ------------------------------------------------------------------------------------------------------

#: Trees and depth of the registered fits.
TREES, DEPTH = 20, 6


def text_features(spark, sf) -> DataFrame:
    """The features of all texts, written once: a fit reads its rows many times, and each time would go through the whole texts."""
    return written(modalities(spark, sf), "modalities")


@query
def fusion_methods(spark, sf):
    """Every metric of nine ways to fuse cheap and costly features."""
    fused = fusion.fuse(text_features(spark, sf), GROUP, CHEAP, COSTLY, TREES, DEPTH)
    return rounded(fusion.fusion_metrics(fused, GROUP))


@query
def stacker_gram_sums(spark, sf):
    """The sums from which all penalties of the stacker are solved."""
    rows = modalities(spark, sf).where("split = 'val'")
    return rounded(linear.gram_sums(rows, GROUP, [*CHEAP, *COSTLY]))


@query
def mixture_em_step(spark, sf):
    """Members' weights after one round of expectation and maximisation."""
    return rounded(fusion.mixture_weights(members(spark, sf), GROUP, rounds=1))


@query
def gate_conditions(spark, sf):
    """Policies under true, absent and permuted costly features, with random controls: means over repeats."""
    rows = gate.gate(text_features(spark, sf).drop("fold_id").withColumn("group_key", F.round(F.col("c_source") * 20).cast("long")), GROUP, CHEAP, COSTLY, "group_key", folds=3, repeats=5, trees=8, depth=4)
    per = rows.groupBy(*GROUP, "condition", "policy", "metric").agg(*[F.avg(c).alias(c) for c in ("value", "gain", "call_rate", "mean_utility", "harm", "captured")])
    return rounded(per)


@query
def baseline_matrix(spark, sf):
    """The endpoint metric of linear, kernel and tree models on all features."""
    rows = text_features(spark, sf)
    features, out = [*CHEAP, *COSTLY], None
    for kind in ("classification", "regression"):
        train, test = (rows.where((F.col("task_type") == kind) & (F.col("split") == s)) for s in ("train", "test"))
        if kind == "classification":
            forest = trees.extra_trees(train, GROUP, features, "y", [0.0, 1.0], trees=TREES, leaf=1, depth=DEPTH)
            got = forest.predict(test, "ExtraTrees").withColumn("ExtraTrees", F.col("ExtraTrees")[1])
            got = linear.balanced_logistic(train, GROUP, features).predict(got, "LR")
            got = linear.kernel_classifier(train, GROUP, features, landmarks=32).predict(got, "SVM_RBF")
            names = ["ExtraTrees", "LR", "SVM_RBF"]
        else:
            got = trees.extra_trees(train, GROUP, features, "y", trees=TREES, leaf=1, depth=DEPTH).predict(test, "ExtraTrees")
            got = linear.ridge_cv(train, GROUP, features, penalties=[1.0]).predict(got, "Ridge")
            got = linear.kernel_regressor(train, GROUP, features, strength=30.0, epsilon=0.05, gamma=0.1, landmarks=32).predict(got, "SVR_RBF")
            got = linear.kernel_ridge(train, GROUP, features, penalty=0.03, gamma=0.1, landmarks=32).predict(got, "KRR_RBF")
            names = ["ExtraTrees", "Ridge", "SVR_RBF", "KRR_RBF"]
        long = got.select(*GROUP, "y", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("pred")) for n in names]))).where("pred is not null")
        scored = metrics.endpoint_metric(long, [*GROUP, "method"])
        out = scored if out is None else out.unionByName(scored)
    return rounded(out)


ROUTER_FEATURES = {"prediction": ["pred2d", "uncertainty"], "full": ["pred2d", "uncertainty", "score", "cost"]}


def objective_items(spark, sf) -> DataFrame:
    """Validation rows with what routers learn from, written once for all fits."""
    v = routing.with_utilities(paired(spark, sf).where("split = 'val'"))
    v = routing.uncertainty(v, ["task", "seed"], v).withColumn("fold_id", (F.col("mol_id") % 5).cast("int"))
    return written(v.select(*GROUP, "mol_id", "fold_id", "y", "pred2d", "pred3d", "utility", "uncertainty", "score", "cost"), "items")


def objective_rows(known: DataFrame, group: str) -> DataFrame:
    """Validation rows with every objective's out-of-fold score."""
    rows = out_of_fold_scores(known, GROUP, "fold_id", 5, ROUTER_FEATURES[group], trees=TREES // 2, depth=DEPTH)
    return written(rows.select(*GROUP, "mol_id", "fold_id", "y", "pred2d", "pred3d", "utility", *OBJECTIVES), "objectives")


@query
def router_objectives(spark, sf):
    """Integrated gain of six objectives' out-of-fold scores."""
    rows = objective_rows(objective_items(spark, sf), "full")
    c = routing.routing_curves(rows, GROUP, {n: F.coalesce(F.col(n), F.lit(0.0)) for n in OBJECTIVES})
    return rounded(metrics.integrated_gain(c, [*GROUP, "router"]))


@query
def objective_grid(spark, sf):
    """The best of objective, feature group and gate by out-of-fold gain, then NDCG."""
    path, best, known = scratch_path(spark, "grid"), [*GROUP, "candidate", "place"], objective_items(spark, sf)
    for i, group in enumerate(ROUTER_FEATURES):
        each = F.array(*[F.struct(F.lit(f"{n}/{group}").alias("candidate"), F.lit(k * len(ROUTER_FEATURES) + i).alias("place"), F.col(n).alias("s")) for k, n in enumerate(OBJECTIVES)])
        rows = objective_rows(known, group).select(*GROUP, "mol_id", "fold_id", "y", "pred2d", "pred3d", "utility", F.inline(each))
        rows.write.mode("append").parquet(path)
    rows = written(selection.fold_scores(spark.read.schema(rows.schema).parquet(path), best, "fold_id", "s", median="half"), "candidates")
    gates = rows.groupBy(*best).agg(F.first("half").alias("half"))
    gates = gates.select(*best, F.inline(F.array(F.struct(F.lit(0).alias("gate"), F.lit(None).cast("double").alias("threshold")), F.struct(F.lit(1).alias("gate"), F.col("half").alias("threshold")))))
    curve = selection.gated_performance(rows.drop("half", "fold_id", "utility"), best, "s", "threshold", gates=gates)
    big = metrics.integrated_gain(curve, [*best, "gate"]).select(*best, "gate", F.round("area", 10).alias("big"))
    n = metrics.ndcg(rows, best, "s", "utility", 20, (known, GROUP)).withColumn("ndcg", F.round("ndcg", 10))
    return rounded(selection.lexicographic_best(big.join(n, best), GROUP, "big", "ndcg", ["place", "gate"]).select("task", "seed", "candidate", "gate", "big", "ndcg"))


# --- streams -----------------------------------------------------------------------------------------------------


@query
def stream_resource_window(spark, sf):
    """Daily peaks of every kind of event, as a stream over the files that are there."""
    out = scratch_path(spark, "stream")
    stream = monitor.samples(spark, sf, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", glob="events.parquet")
    monitor.run_available(monitor.window_peaks(stream, "event_type", "value"), f"{out}/table", f"{out}/checkpoint")
    got = spark.read.schema("start timestamp, event_type string, samples long, peak double").parquet(f"{out}/table")
    return rounded(got.withColumn("start", F.unix_timestamp("start")))
