"""DuckDB SQL for the registered queries, written apart from them: plain windows, no shared code."""

from __future__ import annotations

import math

from .fixtures import CHEAP, COSTLY, EXPERTS, ITEMS, MANIFEST, MEMBERS, MODALITIES, PAIRED

ORACLE_SQL: dict[str, str] = {}


def r(x: str) -> str:
    return f"(round({x}, 8) + 0.0)"


def add(name: str, sql: str, *ctes: str) -> None:
    ORACLE_SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


TEST = "t AS (SELECT * FROM paired WHERE split = 'test')"
VAL = "v AS (SELECT * FROM paired WHERE split = 'val')"


def clip(p: str) -> str:
    return f"greatest(cast(0.000001 AS DOUBLE), least(cast(0.999999 AS DOUBLE), {p}))"


def loss(p: str) -> str:
    return f"CASE WHEN task_type = 'classification' THEN -(y * ln({clip(p)}) + (1 - y) * ln(1 - {clip(p)})) ELSE abs(y - {p}) END"


UTIL = f"u AS (SELECT *, ({loss('pred2d')}) - ({loss('pred3d')}) AS utility FROM paired)"
UT = "ut AS (SELECT * FROM u WHERE split = 'test')"
UV = "uv AS (SELECT * FROM u WHERE split = 'val')"


def auc(source: str, keys: str, y: str, p: str) -> str:
    return f"""SELECT {keys}, CASE WHEN sum({y}) * sum(1 - {y}) > 0 THEN (sum(rk * {y}) - sum({y}) * (sum({y}) + 1) / 2) / (sum({y}) * sum(1 - {y})) END AS AUROC
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}, {p}) - 1) / cast(2 AS DOUBLE) AS rk FROM {source}) GROUP BY {keys}"""


def ap(source: str, keys: str, y: str, p: str) -> str:
    return f"""SELECT {keys}, CASE WHEN sum(pos) > 0 THEN sum(pos * cpos / cn) / sum(pos) END AS AUPRC
FROM (SELECT *, sum(pos) OVER w AS cpos, sum(n) OVER w AS cn
  FROM (SELECT {keys}, {p} AS p, sum({y}) AS pos, cast(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC)) GROUP BY {keys}"""


SCORED = """rs AS (
  SELECT task, task_type, seed, mol_id, y, pred2d, pred3d, unnest(['oracle', 'score', 'uncertain']) AS router,
    unnest([utility, score, -abs(pred2d - cast(0.5 AS DOUBLE))]) AS s FROM ut
),
pos AS (SELECT *, row_number() OVER (PARTITION BY task, seed, router ORDER BY s DESC, mol_id) AS rn, count(*) OVER (PARTITION BY task, seed, router) AS n FROM rs),
bud AS (
  SELECT *, rn <= round_even(n * budget / cast(100 AS DOUBLE), 0) AS sel FROM pos, (SELECT unnest([0, 5, 10, 20, 40, 60, 80, 100]) AS budget)
),
rt AS (SELECT *, CASE WHEN sel THEN pred3d ELSE pred2d END AS routed FROM bud),
au AS (""" + auc("(SELECT * FROM rt WHERE task_type = 'classification')", "task, task_type, seed, router, budget", "y", "routed") + """),
rate AS (SELECT task, task_type, seed, router, budget, avg(cast(sel AS DOUBLE)) AS call_rate, avg(abs(y - routed)) AS mae FROM rt GROUP BY ALL),
curves AS (
  SELECT rate.task, rate.task_type, rate.seed, rate.router, rate.budget, call_rate, CASE WHEN rate.task_type = 'classification' THEN 'AUROC' ELSE 'MAE' END AS metric,
    CASE WHEN rate.task_type = 'classification' THEN AUROC ELSE mae END AS value,
    CASE WHEN rate.task_type = 'classification' THEN AUROC ELSE -mae END AS performance
  FROM rate LEFT JOIN au USING (task, task_type, seed, router, budget)
)"""


def area(value: str, baseline: bool) -> str:
    base = f"{value} - first_value({value}) OVER w" if baseline else value
    return f"""SELECT task, task_type, seed, router, coalesce(sum((budget - lb) / cast(100 AS DOUBLE) * (v + lv) / 2), 0) AS area, any_value(p0) AS p0
FROM (SELECT *, lag(budget) OVER w AS lb, lag(v) OVER w AS lv FROM (
  SELECT *, first_value({value}) OVER w AS p0, {base} AS v FROM curves WINDOW w AS (PARTITION BY task, seed, router ORDER BY budget)
) WINDOW w AS (PARTITION BY task, seed, router ORDER BY budget)) GROUP BY ALL"""


GAINS = f"gains AS ({area('performance', True)})"
C = (PAIRED, UTIL, UT, SCORED)
G = (*C, GAINS)


def top(source: str, score: str, budget: str, rounding: str = "round_even", more: str = "TRUE") -> str:
    cut = f"round_even(n * {budget} / cast(100 AS DOUBLE), 0)" if rounding == "round_even" else f"ceil(n * {budget} / cast(100 AS DOUBLE))"
    return f"""(SELECT *, rn <= {cut} AND {more} AS sel FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY {score} DESC, mol_id) AS rn, count(*) OVER (PARTITION BY task, seed) AS n FROM {source}))"""


def diagnostics(gain: str, keys: str) -> str:
    return f"""{keys}, cast(count(*) FILTER (sel) AS BIGINT) AS selected,
  {r(f"coalesce(count(*) FILTER (sel AND {gain} < 0) / cast(nullif(count(*) FILTER (sel), 0) AS DOUBLE), 0)")} AS harmful,
  {r(f"coalesce(count(*) FILTER (sel AND {gain} > 0) / cast(nullif(count(*) FILTER (sel), 0) AS DOUBLE), 0)")} AS beneficial,
  {r(f"avg({gain}) FILTER (sel)")} AS mean_gain, {r(f"coalesce(sum({gain}) FILTER (sel), 0)")} AS sum_gain,
  {r(f"coalesce(sum(greatest({gain}, 0)) FILTER (sel), 0) / nullif(sum(greatest({gain}, 0)), 0)")} AS captured"""


# --- routing
add("big_by_router", f"SELECT task, task_type, seed::BIGINT AS seed, router, {r('area')} AS area, {r('p0')} AS p0 FROM gains", *G)
add("routing_curve", f"SELECT task, task_type, seed::BIGINT AS seed, router, budget::BIGINT AS budget, {r('call_rate')} AS call_rate, {r('value')} AS value, metric FROM curves", *C)
BUDGETS = (0, 5, 10, 20, 40, 60, 80, 100)


def each_budget(source: str, score: str) -> str:
    return " UNION ALL ".join(f"SELECT *, {b} AS budget FROM {top(source, score, str(b))}" for b in BUDGETS)


add(
    "gated_curve",
    f"""SELECT task, seed::BIGINT AS seed, budget::BIGINT AS budget, {r('avg(abs(y - CASE WHEN sel AND score >= threshold THEN pred3d ELSE pred2d END))')} AS mae,
  {r('avg(cast(sel AND score >= threshold AS DOUBLE))')} AS call_rate, {r('any_value(threshold)')} AS threshold
FROM ({each_budget("reg", "score")}) JOIN gate USING (task, seed) GROUP BY task, seed, budget""",
    PAIRED, "reg AS (SELECT * FROM paired WHERE split = 'test' AND task_type = 'regression')",
    "gate AS (SELECT task, seed, quantile_cont(score, 0.5) AS threshold FROM paired WHERE split = 'train' AND task_type = 'regression' GROUP BY ALL)",
)
add("positive_topk", f"SELECT seed::BIGINT AS seed, {diagnostics('utility', 'task')} FROM {top('ut', 'utility', '60', more='utility > 0')} GROUP BY task, seed", PAIRED, UTIL, UT)
add("ceil_topk", f"SELECT task, seed::BIGINT AS seed, mol_id, rn AS position FROM {top('t', 'score', '7', 'ceil')} WHERE sel", PAIRED, TEST)
add("fixed_topk", f"SELECT task, seed::BIGINT AS seed, mol_id, rn AS position FROM {top('t', 'score', '7')} WHERE rn <= 12", PAIRED, TEST)
add("utility_logloss", f"SELECT task, seed::BIGINT AS seed, mol_id, {r('utility')} AS utility FROM ut", PAIRED, UTIL, UT)
add("utility_margin", f"SELECT task, seed::BIGINT AS seed, mol_id, {r('(2 * y - 1) * (pred3d - pred2d)')} AS margin FROM t WHERE task_type = 'classification'", PAIRED, TEST)
add(
    "utility_auc_contrib",
    f"""SELECT a.task, a.seed::BIGINT AS seed, a.mol_id, {r('a.y')} AS y, {r('''sum(CASE WHEN a.y = 1 THEN
    (sign(a.pred3d - b.pred2d) - sign(a.pred2d - b.pred2d)) / cast(2 AS DOUBLE) ELSE (sign(b.pred2d - a.pred3d) - sign(b.pred2d - a.pred2d)) / cast(2 AS DOUBLE) END)
    / count(*) / any_value(a.size)''')} AS contribution
FROM (SELECT *, count(*) OVER (PARTITION BY task, seed, y) AS size FROM t WHERE task_type = 'classification') a JOIN t b ON a.task = b.task AND a.seed = b.seed AND a.y <> b.y GROUP BY a.task, a.seed, a.mol_id, a.y""",
    PAIRED, TEST,
)
add(
    "cost_penalised_utility",
    f"SELECT task, seed::BIGINT AS seed, mol_id, {r('utility - cast(0.1 AS DOUBLE) * (cost - avg(cost) OVER w) / stddev_pop(cost) OVER w')} AS penalised FROM ut WINDOW w AS (PARTITION BY task, seed)",
    PAIRED, UTIL, UT,
)
add(
    "uncertainty",
    f"""SELECT task, seed::BIGINT AS seed, mol_id, {r("CASE WHEN task_type = 'classification' THEN 1 - greatest(pred2d, 1 - pred2d) ELSE abs(pred2d - m) / s END")} AS uncertainty
FROM t JOIN (SELECT task, seed, avg(pred2d) AS m, stddev_pop(pred2d) AS s FROM paired WHERE split = 'train' GROUP BY ALL) USING (task, seed)""",
    PAIRED, TEST,
)
add(
    "noise_penalised_route",
    f"""SELECT task, seed::BIGINT AS seed, count(*) FILTER (sel) AS called, cast(sum(mol_id) FILTER (sel) AS BIGINT) AS ids FROM {top('n', 'p', '40', more='p > 0')} GROUP BY task, seed""",
    PAIRED, TEST, "n AS (SELECT * EXCLUDE (split), score - cast(1.5 AS DOUBLE) * stddev_pop(score) OVER (PARTITION BY task, seed) AS p FROM t)",
)
add(
    "placebo_permutation",
    f"""SELECT a.task, a.seed::BIGINT AS seed, a.mol_id, {r('b.pred3d')} AS placebo FROM
  (SELECT task, seed, mol_id, row_number() OVER (PARTITION BY task, seed ORDER BY mol_id) AS place FROM t) a JOIN
  (SELECT task, seed, pred3d, row_number() OVER (PARTITION BY task, seed ORDER BY ('0x' || substr(md5('7:' || mol_id), 1, 8))::BIGINT, mol_id) AS place FROM t) b
  USING (task, seed, place)""",
    PAIRED, TEST,
)


def hashed(row: str, turn: str, seed: int, modulus: str) -> str:
    x = f"(({turn} * 48271 + {row} * 40692 + {seed * 69621 + 12345}) % 2147483647)"
    x1 = f"(({x} * {x} + {turn}) % 2147483647)"
    x2 = f"(({x1} * 16807 + {row}) % 2147483647)"
    return f"((({x2} * {x2} + 1) % 2147483647) % {modulus})"


add(
    "random_policy",
    f"""SELECT task, seed::BIGINT AS seed, {r('avg(abs(y - CASE WHEN sel THEN pred3d ELSE pred2d END))')} AS mae, count(*) FILTER (sel) AS called FROM {top('d', 'dice', '20')} GROUP BY task, seed""",
    PAIRED, TEST, f"d AS (SELECT *, {hashed('mol_id', 'seed::BIGINT', 3, '1000003')} AS dice FROM t WHERE task_type = 'regression')",
)
PICK = """pick AS (SELECT *, greatest(score_rich, score_scalar) AS best, CASE WHEN score_rich = greatest(score_rich, score_scalar) THEN 'rich' ELSE 'scalar' END AS who FROM experts)"""
add(
    "expert_argmax",
    f"""SELECT task, seed::BIGINT AS seed, expert, count(*) AS n, {r('avg(CASE WHEN expert IS NOT NULL THEN best END)')} AS mean_score,
  {r("avg(CASE expert WHEN 'rich' THEN pred_rich WHEN 'scalar' THEN pred_scalar END)")} AS mean_pred
FROM (SELECT *, CASE WHEN best > 0 AND task <> 'T_O' THEN who END AS expert FROM pick) GROUP BY task, seed, expert""",
    EXPERTS, PICK,
)
add(
    "multi_expert_route",
    f"""SELECT task, seed::BIGINT AS seed, {r("avg(abs(y - CASE WHEN sel THEN CASE who WHEN 'rich' THEN pred_rich ELSE pred_scalar END ELSE pred2d END))")} AS mae, {r('avg(cast(sel AS DOUBLE))')} AS call_rate
FROM (SELECT *, rn <= round_even(n * 20 / cast(100 AS DOUBLE), 0) AND best > 0 AS sel FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY CASE WHEN best > 0 THEN best END DESC NULLS LAST, mol_id) AS rn, count(*) OVER (PARTITION BY task, seed) AS n
  FROM pick WHERE task_type = 'regression')) GROUP BY task, seed""",
    EXPERTS, PICK,
)
add(
    "support_features",
    f"""SELECT task, fold_id::BIGINT AS fold_id, {r('ln(1 + coalesce(any_value(k), 0))')} AS support, count(*) AS n
FROM t LEFT JOIN (SELECT task, fold_id, count(*) AS k FROM paired WHERE seed = 0 AND fold_id < 3 GROUP BY ALL) USING (task, fold_id) WHERE seed = 0 GROUP BY task, fold_id""",
    PAIRED, TEST,
)
add(
    "tanimoto_nn",
    f"""SELECT a.vec_id, {r("max(coalesce(list_inner_product(a.b, b.b) / nullif(list_sum(a.b) + list_sum(b.b) - list_inner_product(a.b, b.b), 0), 0))")} AS nearest
FROM f a JOIN f b ON a.vec_id <> b.vec_id AND b.vec_id % 10 < 8 GROUP BY a.vec_id""",
    "f AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END) AS b FROM embeddings)",
)
add(
    "ood_support",
    f"""SELECT a.vec_id, {r("ln(1 + (SELECT count(*) FROM embeddings c WHERE c.label = a.label AND c.vec_id % 10 < 8))")} AS support,
  {r("1 - max(coalesce(list_inner_product(a.b, b.b) / nullif(list_sum(a.b) + list_sum(b.b) - list_inner_product(a.b, b.b), 0), 0))")} AS ood
FROM f a JOIN f b ON a.vec_id <> b.vec_id AND b.vec_id % 10 < 8 WHERE a.vec_id % 10 >= 8 GROUP BY a.vec_id, a.label""",
    "f AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN cast(1 AS DOUBLE) ELSE cast(0 AS DOUBLE) END) AS b FROM embeddings)",
)
# --- metrics
add(
    "mae_rmse_r2",
    f"""SELECT task, seed::BIGINT AS seed, {r('avg(abs(y - pred2d))')} AS MAE, {r('sqrt(avg((y - pred2d) * (y - pred2d)))')} AS RMSE,
  {r('1 - avg((y - pred2d) * (y - pred2d)) / var_pop(y)')} AS R2 FROM t GROUP BY task, seed""",
    PAIRED, TEST,
)
CLS = "c AS (SELECT * FROM t WHERE task_type = 'classification')"
add("auroc", f"SELECT task, seed::BIGINT AS seed, {r('AUROC')} AS AUROC FROM ({auc('c', 'task, seed', 'y', 'pred3d')})", PAIRED, TEST, CLS)
add("auprc", f"SELECT task, seed::BIGINT AS seed, {r('AUPRC')} AS AUPRC FROM ({ap('c', 'task, seed', 'y', 'pred3d')})", PAIRED, TEST, CLS)
add(
    "accuracy_logloss",
    f"SELECT task, seed::BIGINT AS seed, {r('avg(cast((pred2d >= 0.5) = (y = 1) AS DOUBLE))')} AS Accuracy, {r('avg(' + loss('pred2d') + ')')} AS LogLoss FROM c GROUP BY task, seed",
    PAIRED, TEST, CLS,
)
add(
    "ndcg_at_budget",
    f"""SELECT task, seed::BIGINT AS seed, {r('sum(CASE WHEN rn <= k THEN ar / log2(rn + 1) ELSE 0 END) / nullif(sum(CASE WHEN ri <= k THEN rel / log2(ri + 1) ELSE 0 END), 0)')} AS ndcg
FROM (SELECT *, avg(rel) OVER (PARTITION BY task, seed, s) AS ar, row_number() OVER (PARTITION BY task, seed ORDER BY s DESC) AS rn,
    row_number() OVER (PARTITION BY task, seed ORDER BY rel DESC) AS ri, greatest(1, round_even(count(*) OVER (PARTITION BY task, seed) * 20 / cast(100 AS DOUBLE), 0)) AS k
  FROM (SELECT task, seed, greatest(utility, 0) AS rel, round(score, 2) AS s FROM ut)) GROUP BY task, seed""",
    PAIRED, UTIL, UT,
)
add(
    "precision_at_budget",
    f"""SELECT task, seed::BIGINT AS seed, {r('avg(cast(utility > 0 AS DOUBLE))')} AS precision FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY score DESC, mol_id) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY task, seed) * 20 / cast(100 AS DOUBLE), 0)) AS k FROM ut
) WHERE rn <= k GROUP BY task, seed""",
    PAIRED, UTIL, UT,
)
add(
    "spearman",
    f"""SELECT task, seed::BIGINT AS seed, {r('corr(a, b)')} AS spearman FROM (
  SELECT task, seed, rank() OVER (PARTITION BY task, seed ORDER BY score) + (count(*) OVER (PARTITION BY task, seed, score) - 1) / cast(2 AS DOUBLE) AS a,
    rank() OVER (PARTITION BY task, seed ORDER BY utility) + (count(*) OVER (PARTITION BY task, seed, utility) - 1) / cast(2 AS DOUBLE) AS b FROM ut) GROUP BY task, seed""",
    PAIRED, UTIL, UT,
)
add("per_item_loss", f"SELECT task, seed::BIGINT AS seed, mol_id, {r(loss('pred2d'))} AS loss2d, {r(loss('pred3d'))} AS loss3d FROM t", PAIRED, TEST)
add(
    "text_label_auroc",
    f"SELECT task, {r('AUROC')} AS AUROC, {r('AUPRC')} AS AUPRC FROM ({auc('i', 'task', 'quality', 'n_chars')}) JOIN ({ap('i', 'task', 'quality', 'n_chars')}) USING (task)",
    ITEMS, "i AS (SELECT * FROM items WHERE quality IS NOT NULL)",
)
ENDS = f"""ends AS (
  SELECT a.task, a.seed, 'AUROC' AS metric, a.AUROC AS ref, b.AUROC AS alt, b.AUROC - a.AUROC AS gain FROM ({auc('c', 'task, seed', 'y', 'pred2d')}) a JOIN ({auc('c', 'task, seed', 'y', 'pred3d')}) b USING (task, seed)
  UNION ALL SELECT task, seed, 'MAE', avg(abs(y - pred2d)), avg(abs(y - pred3d)), avg(abs(y - pred2d)) - avg(abs(y - pred3d)) FROM t WHERE task_type = 'regression' GROUP BY task, seed
)"""
CATEGORY = "CASE WHEN g >= 1 THEN 'helpful' WHEN g <= -1 THEN 'harmful' WHEN g IS NOT NULL THEN 'neutral' END"
add(
    "endpoint_gain",
    f"SELECT task, seed::BIGINT AS seed, metric, {r('gain')} AS gain, {CATEGORY} AS category FROM (SELECT *, CASE WHEN metric = 'AUROC' THEN gain / 0.01::DOUBLE ELSE gain / abs(ref) / 0.02::DOUBLE END AS g FROM ends)",
    PAIRED, TEST, CLS, ENDS,
)
# --- summaries
add(
    "summarize_curves",
    f"""SELECT task, router, budget::BIGINT AS budget, {r('avg(value)')} AS value_mean, {r('stddev_pop(value)')} AS value_std, {r('avg(call_rate)')} AS call_rate_mean,
  {r('stddev_pop(call_rate)')} AS call_rate_std, count(DISTINCT seed) AS n_seed FROM curves GROUP BY task, router, budget""",
    *C,
)
add("macro_task_mean", f"SELECT router, {r('avg(a)')} AS area, {r('avg(p)')} AS p0 FROM (SELECT task, router, avg(area) AS a, avg(p0) AS p FROM gains GROUP BY ALL) GROUP BY router", *G)
add(
    "normalized_big",
    f"""SELECT task, task_type, seed::BIGINT AS seed, router, {r('area')} AS area, {r('o')} AS oracle_area, {r('area / (abs(o) + cast(0.00000001 AS DOUBLE))')} AS normalised
FROM gains JOIN (SELECT task, seed, area AS o FROM gains WHERE router = 'oracle') USING (task, seed)""",
    *G,
)
add("pareto_auc", f"SELECT task, task_type, seed::BIGINT AS seed, router, {r('area')} AS area, {r('p0')} AS p0 FROM ({area('value', False)})", *C)
add(
    "oracle_recovery",
    f"""SELECT task, task_type, seed::BIGINT AS seed, router, {r('gain')} AS gain, {r('CASE WHEN abs(og) > 1e-12 THEN gain / og END')} AS recovered
FROM (SELECT *, max(CASE WHEN router = 'oracle' THEN gain END) OVER (PARTITION BY task, seed) AS og FROM (
  SELECT task, task_type, seed, router, max(CASE WHEN budget = 20 THEN performance END) - max(CASE WHEN budget = 0 THEN performance END) AS gain FROM curves GROUP BY ALL))""",
    *C,
)
add(
    "never3d_pareto",
    f"""SELECT router, budget::BIGINT AS budget, {r('avg(performance)')} AS performance, count(*) FILTER (call_rate > 0) AS active, count(*) AS n FROM (
  SELECT router, budget, performance, call_rate FROM curves UNION ALL
  SELECT unnest(['always_abstain', 'never_3d']), b, performance, 0 FROM (SELECT * FROM curves WHERE budget = 0 AND router = 'oracle'), (SELECT DISTINCT budget AS b FROM curves)
) GROUP BY router, budget""",
    *C,
)
WIDE = "wide AS (SELECT task, seed, max(CASE router WHEN 'oracle' THEN area END) AS oracle, max(CASE router WHEN 'score' THEN area END) AS score, max(CASE router WHEN 'uncertain' THEN area END) AS uncertain FROM gains GROUP BY ALL)"
add("pivot_router", f"SELECT task, seed::BIGINT AS seed, {r('oracle')} AS oracle, {r('score')} AS score, {r('uncertain')} AS uncertain FROM wide", *G, WIDE)
add("unpivot_router", f"SELECT task, seed::BIGINT AS seed, router, {r('area')} AS area FROM gains WHERE router <> 'uncertain'", *G)
add(
    "best_router",
    f"""SELECT task, seed::BIGINT AS seed, router, {r('area')} AS area FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY round(area, 10) DESC, router) AS rn FROM gains WHERE router <> 'oracle') WHERE rn = 1""",
    *G,
)
add("rank_routers", f"SELECT task, router, {r('area')} AS area, rank() OVER (PARTITION BY task ORDER BY area DESC) AS rank FROM (SELECT task, router, round(avg(area), 10) AS area FROM gains GROUP BY ALL)", *G)
POISSON = [math.floor(1e6 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def weighted(columns: str, item: str, source: str, repeats: int) -> str:
    """The source once for each resample, with w, how often the resample draws the item."""
    u = hashed(f"({item} % 2147483647)", "turn", 0, "1000000")
    w = " + ".join(f"(u >= {c})::INT" for c in POISSON)
    return f"SELECT *, {w} AS w FROM (SELECT {columns}, turn, {u} AS u FROM {source}, (SELECT unnest(range(0, {repeats})) AS turn))"


BOOT = f"""weighted AS ({weighted('task, seed, utility', 'mol_id', 'uv', 1000)}),
means AS (SELECT task, seed, turn, sum(w * utility) / nullif(sum(w), 0) AS m FROM weighted GROUP BY ALL),
bounds AS (
  SELECT task, seed, n, mean, CASE WHEN n >= 8 THEN lcb END AS lcb FROM (SELECT task, seed, quantile_cont(m, 0.025) AS lcb FROM means GROUP BY ALL)
  JOIN (SELECT task, seed, count(*) AS n, avg(utility) AS mean FROM uv GROUP BY ALL) USING (task, seed)
)"""
B = (PAIRED, UTIL, UV, BOOT)
add("safe_decision_pivot", "SELECT task, count(*) FILTER (lcb > 0) AS call, count(*) FILTER (lcb IS NULL OR lcb <= 0) AS abstain FROM bounds GROUP BY task", *B)
add(
    "risk_coverage",
    f"SELECT seed::BIGINT AS seed, budget::BIGINT AS budget, {diagnostics('utility', 'task')} FROM ({each_budget('ut', 'score')}) GROUP BY task, seed, budget",
    PAIRED, UTIL, UT,
)
add(
    "selected_contrast",
    f"""SELECT task, feature, {r('avg(value) FILTER (sel)')} AS inside, {r('avg(value) FILTER (NOT sel)')} AS outside, count(*) FILTER (sel) AS n
FROM (SELECT task, sel, unnest(['y', 'pred2d', 'cost']) AS feature, unnest([y, pred2d, cost]) AS value FROM {top('t', 'score', '20')}) GROUP BY task, feature""",
    PAIRED, TEST,
)
# --- policies and inference
def placed(p: str) -> str:
    return f"""SELECT a.task, a.seed, a.mol_id, a.y, avg(CASE WHEN a.y = 1 THEN (sign(a.{p} - b.{p}) + 1) / cast(2 AS DOUBLE) ELSE (sign(b.{p} - a.{p}) + 1) / cast(2 AS DOUBLE) END) AS x
FROM vc a JOIN vc b ON a.task = b.task AND a.seed = b.seed AND a.y <> b.y GROUP BY ALL"""


def sides(split: str, cls: str) -> str:
    """task, seed, the reference's metric and the endpoint gain."""
    return f"""SELECT a.task, a.seed, a.AUROC AS ref, b.AUROC - a.AUROC AS gain FROM ({auc(cls, 'task, seed', 'y', 'pred2d')}) a JOIN ({auc(cls, 'task, seed', 'y', 'pred3d')}) b USING (task, seed)
  UNION ALL SELECT task, seed, avg(abs(y - pred2d)), avg(abs(y - pred2d)) - avg(abs(y - pred3d)) FROM paired WHERE split = '{split}' AND task_type = 'regression' GROUP BY task, seed"""


VC = "vc AS (SELECT * FROM paired WHERE split = 'val' AND task_type = 'classification'), tc AS (SELECT * FROM paired WHERE split = 'test' AND task_type = 'classification')"
DELONG = f"""delong AS (SELECT task, seed, avg(m) AS gain, CASE WHEN count(v) = 2 THEN sum(v / n) END AS variance FROM (
  SELECT task, seed, y, avg(a.x - b.x) AS m, var_samp(a.x - b.x) AS v, count(*) AS n FROM ({placed('pred3d')}) a JOIN ({placed('pred2d')}) b USING (task, seed, mol_id, y) GROUP BY ALL) GROUP BY task, seed)"""
#: The one-sided 2.5 percent point of Student's distribution by its expansion about the normal one's.
POINT = "(1.959963984540054::DOUBLE + 2.372271230 / f + 2.8224986 / f ** 2 + 2.5558497 / f ** 3 + 1.5895341 / f ** 4)"
TESTS = f"""{VC}, {DELONG}, tests AS (
  SELECT task, seed, gain, coalesce(CASE WHEN variance <= 0 THEN gain > 0 ELSE gain > 0 AND gain / sqrt(variance) > 1.959963984540054 END, FALSE) AS ok FROM delong
  UNION ALL SELECT task, seed, gain, coalesce(CASE WHEN se <= 0 THEN gain > 0 ELSE gain > 0 AND gain / se > {POINT} END, FALSE) FROM (
    SELECT task, seed, avg(d) AS gain, stddev_samp(d) / sqrt(count(*)) AS se, count(*) - 1 AS f FROM (
      SELECT task, seed, abs(y - pred2d) - abs(y - pred3d) AS d FROM paired WHERE split = 'val' AND task_type = 'regression') GROUP BY ALL)
)"""
POLICIES = f"""{TESTS}, val AS ({sides('val', 'vc')}), tst AS ({sides('test', 'tc')}),
st AS (SELECT val.task, val.seed, val.gain AS vg, val.gain / nullif(abs(val.ref), 0) AS rel, tst.gain AS g, lcb, ok
  FROM val JOIN tst USING (task, seed) JOIN bounds USING (task, seed) JOIN tests USING (task, seed)),
pol AS (
  SELECT task, seed, g, 'Always-2D' AS policy, FALSE AS p FROM st
  UNION ALL SELECT task, seed, g, 'Always-2D+3D', TRUE FROM st
  UNION ALL SELECT task, seed, g, 'TaskSelect', vg > 0 FROM st
  UNION ALL SELECT task, seed, g, 'ThresholdSelect-0.5pct', coalesce(rel > 0.005, FALSE) FROM st
  UNION ALL SELECT task, seed, g, 'ThresholdSelect-1pct', coalesce(rel > 0.01, FALSE) FROM st
  UNION ALL SELECT task, seed, g, 'TaskMetric-LCB', coalesce(lcb > 0, FALSE) FROM st
  UNION ALL SELECT task, seed, g, 'PairedTest-0.025', ok FROM st
),
outc AS (SELECT *, CASE WHEN p THEN g ELSE 0 END AS pg FROM pol)"""
P = (*B, POLICIES)
add(
    "policy_states",
    f"""SELECT task, seed::BIGINT AS seed, policy, p AS permission, {r('g')} AS test_gain, {r('pg')} AS policy_gain, p = (g > 0) AS decision_correct, p AND g <= 0 AS false_activation,
  NOT p AND g > 0 AS false_rejection, {r('greatest(0, -pg)')} AS negative_transfer, {r('CASE WHEN NOT p AND g > 0 THEN g ELSE 0 END')} AS missed_gain, {r('greatest(g, 0) - pg')} AS regret FROM outc""",
    *P,
)
add(
    "risk_benefit",
    f"""SELECT policy, {r('avg(p::DOUBLE)')} AS activation, {r('avg((p AND g <= 0)::DOUBLE)')} AS false_activation, {r('avg((NOT p AND g > 0)::DOUBLE)')} AS false_rejection,
  {r('coalesce(sum(greatest(g, 0)) FILTER (p), 0) / nullif(sum(greatest(g, 0)), 0)')} AS gain_retention,
  {r('coalesce(sum(greatest(-g, 0)) FILTER (NOT p), 0) / nullif(sum(greatest(-g, 0)), 0)')} AS harm_avoidance FROM pol GROUP BY policy""",
    *P,
)
add(
    "selector_summary",
    f"""SELECT policy, {r('avg(pg)')} AS mean_gain, {r('stddev_samp(pg)')} AS sd_gain, count(DISTINCT task) AS tasks, count(*) AS n, {r('sum(greatest(g, 0) - pg)')} AS regret,
  {r('min(pg)')} AS least, {r('max(pg)')} AS most, {r('avg((p = (g > 0))::DOUBLE)')} AS correct FROM outc GROUP BY policy""",
    *P,
)
add(
    "selector_split_level",
    f"""SELECT a.seed::BIGINT AS seed, a.policy, {r('a.gain')} AS gain, {r('b.gain')} AS always, a.gain > b.gain AS won
FROM (SELECT seed, policy, avg(pg) AS gain FROM outc GROUP BY ALL) a JOIN (SELECT seed, avg(pg) AS gain FROM outc WHERE policy = 'Always-2D+3D' GROUP BY ALL) b ON a.seed = b.seed""",
    *P,
)


add(
    "delong_stat",
    f"SELECT task, seed::BIGINT AS seed, {r('gain')} AS gain, {r('variance')} AS variance, {r('gain / sqrt(variance)')} AS z, ok AS permission FROM delong JOIN tests USING (task, seed, gain)",
    PAIRED, TESTS,
)
add(
    "paired_t_stat",
    f"""SELECT task, seed::BIGINT AS seed, n, {r('a.gain')} AS gain, {r('t')} AS t, ok AS permission FROM (
  SELECT task, seed, count(*) AS n, avg(d) AS gain, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM (SELECT *, abs(y - pred2d) - abs(y - pred3d) AS d FROM v WHERE task_type = 'regression') GROUP BY task, seed) a
JOIN tests USING (task, seed)""",
    PAIRED, VAL, TESTS,
)
add(
    "holm_bh",
    f"""SELECT s_nationkey::BIGINT AS s_nationkey, s_suppkey, {r('p')} AS p, {r('max(least(1, (m - k + 1) * p)) OVER (w ROWS UNBOUNDED PRECEDING)')} AS holm,
  {r('min(least(1, p * m / k)) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS bh
FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS m, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS k
  FROM (SELECT s_nationkey, s_suppkey, cast(s_suppkey * 37 % 17 AS DOUBLE) / 200 AS p FROM supplier)) WINDOW w AS (PARTITION BY s_nationkey ORDER BY p, s_suppkey)""",
)
add("hashed_bootstrap_lcb", f"SELECT task, seed::BIGINT AS seed, n, {r('mean')} AS mean, {r('lcb')} AS lcb FROM bounds", *B)
add(
    "hashed_sign_perm",
    f"""SELECT task, seed::BIGINT AS seed, any_value(n) AS n, {r('any_value(mean)')} AS mean,
  {r('greatest(avg((CASE WHEN round(mean, 12) >= 0 THEN round(m, 12) >= round(mean, 12) ELSE round(m, 12) <= round(mean, 12) END)::DOUBLE), 1 / 20000::DOUBLE)')} AS p,
  {r('greatest(avg((abs(round(m, 12)) >= abs(round(mean, 12)))::DOUBLE), 1 / 20000::DOUBLE)')} AS p_two FROM (
  SELECT task, seed, turn, avg(CASE WHEN coin = 1 THEN utility ELSE -utility END) AS m, avg(utility) AS mean, count(*) AS n FROM (
    SELECT *, (coins >> (turn % 16)) & 1 AS coin FROM (SELECT *, {hashed('(mol_id % 2147483647)', 'block', 0, '65536')} AS coins FROM uv, (SELECT unnest(range(0, 1250)) AS block))
    JOIN (SELECT unnest(range(0, 20000)) AS turn) ON block = turn // 16) GROUP BY ALL
) GROUP BY task, seed""",
    PAIRED, UTIL, UV,
)
add(
    "paired_test_decisions",
    "SELECT task, count(*) FILTER (ok) AS permitted, round(avg((ok = coalesce(lcb > 0, FALSE))::DOUBLE), 8) AS agreement, count(*) AS n FROM tests JOIN bounds USING (task, seed) GROUP BY task",
    *B, TESTS,
)


def booted(source: str, keys: str, value: str, item: str, quantiles: str, repeats: int) -> str:
    """keys, n, mean and the quantiles of means over hashed resamples of the source."""
    return f"""SELECT * FROM (SELECT {keys}, {quantiles} FROM (SELECT {keys}, turn, sum(w * v) / nullif(sum(w), 0) AS m FROM ({weighted(f'{keys}, {value} AS v', item, source, repeats)}) GROUP BY ALL) GROUP BY {keys})
  JOIN (SELECT {keys}, count(*) AS n, avg({value}) AS mean FROM {source} GROUP BY {keys}) USING ({keys})"""


CHOSEN = f"chosen AS (SELECT * FROM {top('ut', 'score', '20')} WHERE sel)"
add(
    "lcb_alpha_sweep",
    f"""SELECT task, seed::BIGINT AS seed, n, {r('mean')} AS mean, alpha::DOUBLE AS alpha, {r('lcb')} AS lcb, lcb > 0 AS permit, lcb > 0 AND mean <= 0 AS false_safe FROM (
  SELECT task, seed, n, mean, unnest([0.01, 0.025, 0.05, 0.1]) AS alpha, unnest(q) AS lcb FROM ({booted('chosen', 'task, seed', 'utility', 'mol_id', 'quantile_cont(m, [0.01, 0.025, 0.05, 0.1]) AS q', 2000)}))""",
    PAIRED, UTIL, UT, CHOSEN,
)
add(
    "utility_lcb_permission",
    f"""SELECT task, seed::BIGINT AS seed, n, {r('mean')} AS mean, {r('CASE WHEN n >= 8 THEN lcb END')} AS lcb, CASE WHEN n >= 8 AND lcb > 0 AND mean > 0 THEN 'call' ELSE 'abstain' END AS decision
FROM ({booted('chosen', 'task, seed', 'utility', 'mol_id', 'quantile_cont(m, 0.025) AS lcb', 500)})""",
    PAIRED, UTIL, UV, f"chosen AS (SELECT * FROM {top('uv', 'score', '20')} WHERE sel)",
)
add(
    "paired_delta_ci",
    f"""SELECT contrast, n, {r('mean')} AS mean, {r('CASE WHEN n >= 8 THEN q[1] END')} AS low, {r('CASE WHEN n >= 8 THEN q[2] END')} AS high
FROM ({booted('pairs', 'contrast', 'delta', 'pair', 'quantile_cont(m, [0.025, 0.975]) AS q', 1000)})""",
    *G, WIDE, "pairs AS (SELECT 'score-uncertain' AS contrast, score - uncertain AS delta, ascii(substr(task, 3, 1)) * 10 + seed AS pair FROM wide)",
)
add(
    "oof_fold_scores",
    f"""SELECT task, seed::BIGINT AS seed, count(*) AS n, {r('sum(coalesce(s, fill))')} AS total, {r('min(coalesce(s, fill))')} AS least FROM (
  SELECT *, median(s) OVER w AS fill, count(s) OVER w AS known, count(*) OVER w AS rows FROM (
    SELECT task, seed, CASE WHEN count(*) OVER (PARTITION BY task, seed) - count(*) OVER (PARTITION BY task, seed, fold_id) >= 16 AND (fold_id <> 2 OR mol_id % 4 = 0) THEN score END AS s FROM tr)
  WINDOW w AS (PARTITION BY task, seed)) WHERE known >= greatest(16, floor(rows / 2)) AND known >= 0.8::DOUBLE * rows GROUP BY task, seed""",
    PAIRED, "tr AS (SELECT * FROM paired WHERE split = 'train')",
)
CANDIDATES = """cand AS (SELECT task, task_type, seed, mol_id, y, pred2d, pred3d, utility, unnest([0, 1, 2]) AS place, unnest(['score', 'cheap', 'shift']) AS candidate, unnest([score, -cost, abs(pred3d - pred2d)]) AS s FROM uv),
gat AS (SELECT *, unnest([0, 1]) AS gate FROM (SELECT *, median(s) OVER (PARTITION BY task, seed, place) AS half, row_number() OVER (PARTITION BY task, seed, place ORDER BY s DESC, mol_id) AS k, count(*) OVER (PARTITION BY task, seed, place) AS n FROM cand)),
gr AS (SELECT *, CASE WHEN k <= round_even(n * budget / cast(100 AS DOUBLE), 0) AND (gate = 0 OR s >= half) THEN pred3d ELSE pred2d END AS p FROM gat, (SELECT unnest([0, 5, 10, 20, 40, 60, 80, 100]) AS budget)),
ga AS (""" + auc("(SELECT * FROM gr WHERE task_type = 'classification')", "task, seed, place, gate, budget", "y", "p") + """),
perf AS (SELECT task, seed, place, gate, budget, CASE WHEN any_value(task_type) = 'classification' THEN any_value(AUROC) ELSE -avg(abs(y - p)) END AS v FROM gr LEFT JOIN ga USING (task, seed, place, gate, budget) GROUP BY task, seed, place, gate, budget),
big AS (SELECT task, seed, place, gate, round(coalesce(sum((budget - lb) / cast(100 AS DOUBLE) * (d + ld) / 2), 0), 10) AS big FROM (
  SELECT *, lag(budget) OVER w AS lb, lag(d) OVER w AS ld FROM (SELECT *, v - first_value(v) OVER (PARTITION BY task, seed, place, gate ORDER BY budget) AS d FROM perf) WINDOW w AS (PARTITION BY task, seed, place, gate ORDER BY budget)) GROUP BY ALL)"""


def ndcg_of(source: str, keys: str, score: str) -> str:
    return f"""SELECT {keys}, sum(CASE WHEN rn <= k THEN ar / log2(rn + 1) ELSE 0 END) / nullif(sum(CASE WHEN ri <= k THEN rel / log2(ri + 1) ELSE 0 END), 0) AS ndcg
FROM (SELECT *, avg(rel) OVER (PARTITION BY {keys}, s_) AS ar, row_number() OVER (PARTITION BY {keys} ORDER BY s_ DESC) AS rn, row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC) AS ri,
    greatest(1, round_even(count(*) OVER (PARTITION BY {keys}) * 20 / cast(100 AS DOUBLE), 0)) AS k
  FROM (SELECT {keys}, greatest(utility, 0) AS rel, {score} AS s_ FROM {source})) GROUP BY {keys}"""


add(
    "oof_router_selection",
    f"""SELECT task, seed::BIGINT AS seed, candidate, gate::BIGINT AS gate, {r('big')} AS big, {r('ndcg')} AS ndcg FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY big DESC NULLS LAST, ndcg DESC NULLS LAST, place, gate) AS rk FROM big
  JOIN (SELECT task, seed, place, candidate, round(ndcg, 10) AS ndcg FROM ({ndcg_of('cand', 'task, seed, place, candidate', 's')})) USING (task, seed, place)) WHERE rk = 1""",
    PAIRED, UTIL, UV, CANDIDATES,
)
add(
    "risk_weight_grid",
    f"""SELECT task, seed::BIGINT AS seed, weight, {r('ndcg')} AS ndcg FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY round(ndcg, 10) DESC, weight) AS rk FROM ({ndcg_of('zz', 'task, seed, weight', 'c')}) WHERE ndcg IS NOT NULL) WHERE rk = 1""",
    PAIRED, UTIL, UV,
    """zz AS (SELECT task, seed, utility, weight::DOUBLE AS weight, (score - ms) / ds - weight::DOUBLE * ((cost - mc) / dc) AS c FROM (
  SELECT *, avg(score) OVER w AS ms, stddev_pop(score) OVER w AS ds, avg(cost) OVER w AS mc, stddev_pop(cost) OVER w AS dc FROM uv WINDOW w AS (PARTITION BY task, seed)), (SELECT unnest([0, 0.25, 0.5, 0.75, 1, 1.5]) AS weight))""",
)
PARTS = """un AS (SELECT * FROM u WHERE split = 'train'), fl AS (SELECT task, seed, list_sort(list(DISTINCT fold_id)) AS f FROM un GROUP BY ALL),
ca AS (SELECT un.*, fold_id = CASE WHEN len(f) >= 3 THEN f[seed % len(f) + 1] ELSE f[len(f)] END AS c FROM un JOIN fl USING (task, seed)),
parts AS (SELECT *, CASE WHEN n - k < 32 OR k < 8 THEN (place - 1) % 5 = 0 ELSE c END AS cal FROM (
  SELECT *, count(*) OVER (PARTITION BY task, seed) AS n, count(*) FILTER (c) OVER (PARTITION BY task, seed) AS k, row_number() OVER (PARTITION BY task, seed ORDER BY mol_id) AS place FROM ca))"""
add(
    "nested_calibration",
    f"""SELECT task, seed::BIGINT AS seed, count(*) AS n, count(*) FILTER (sel AND score >= threshold) AS called, {r('avg(utility) FILTER (sel AND score >= threshold)')} AS mean, {r('any_value(threshold)')} AS threshold
FROM {top('cal', 'score', '60')} JOIN (SELECT task, seed, quantile_cont(score, 0.5) AS threshold FROM parts WHERE NOT cal GROUP BY ALL) USING (task, seed) GROUP BY task, seed""",
    PAIRED, UTIL, PARTS, "cal AS (SELECT task, seed, mol_id, score, utility FROM parts WHERE cal)",
)
add(
    "guardrail_route",
    f"""SELECT task, seed::BIGINT AS seed, count(*) FILTER (sel AND c AND score >= 0.3::DOUBLE) AS called, {r('coalesce(sum(utility) FILTER (sel AND c AND score >= 0.3::DOUBLE), 0)')} AS gain
FROM {top('ut', 'score', '20')} JOIN (SELECT task, seed, coalesce(n >= 8 AND lcb > 0 AND mean > 0, FALSE) AS c FROM bounds) USING (task, seed) GROUP BY task, seed""",
    *B, UT,
)
add(
    "gate1_policies",
    f"""SELECT task, seed::BIGINT AS seed, policy, {r('avg(CASE WHEN on_ THEN utility ELSE 0 END)')} AS gain, {r('avg(on_::DOUBLE)')} AS call_rate FROM (
  SELECT task, seed, utility, unnest(['reference', 'alternative', 'TaskSelect', 'TaskLCB', 'SimpleUtility', 'HoldoutLCB', 'Oracle@20']) AS policy,
    unnest([FALSE, TRUE, coalesce(mean > 0, FALSE), coalesce(lcb > 0, FALSE), sel AND score > 0.5, sel AND coalesce(lcb > 0, FALSE), best AND utility > 0]) AS on_
  FROM {top('ut', 'score', '20')} JOIN (SELECT task, seed, mol_id, sel AS best FROM {top('ut', 'utility', '20')}) USING (task, seed, mol_id) JOIN (SELECT task, seed, mean, lcb FROM bounds) USING (task, seed)) GROUP BY task, seed, policy""",
    *B, UT,
)
add(
    "baseline_aware_candidate",
    f"""SELECT task, metric, {r('CASE WHEN use THEN bv ELSE value END')} AS selected, CASE WHEN use THEN method ELSE 'routed' END AS source, {r('CASE WHEN use THEN 0 ELSE call_rate END')} AS call_rate,
  CASE WHEN use THEN 'abstain' ELSE 'keep' END AS action FROM (
  SELECT f.*, b.bv, b.method, CASE WHEN metric = 'AUROC' THEN bv > value ELSE bv < value END AS use FROM (
    SELECT task, metric, avg(value) AS value, avg(call_rate) AS call_rate FROM curves WHERE router = 'score' AND budget = 20 GROUP BY ALL) f JOIN (
    SELECT task, method, bv, row_number() OVER (PARTITION BY task ORDER BY round(CASE WHEN m = 'AUROC' THEN bv ELSE -bv END, 10) DESC, method) AS rk FROM (
      SELECT task, any_value(metric) AS m, CASE budget WHEN 0 THEN 'cheap' ELSE 'costly' END AS method, avg(value) AS bv FROM curves WHERE router = 'score' AND budget IN (0, 100) GROUP BY task, budget
      HAVING count(DISTINCT seed) >= 5)) b ON f.task = b.task AND rk = 1)""",
    *C,
)
add(
    "budget_rounding_audit",
    f"""SELECT task, seed::BIGINT AS seed, n, budget::BIGINT AS budget, called::BIGINT AS called, rounded_up, {r('called / n')} AS call_rate, {r('called / n - budget / cast(100 AS DOUBLE)')} AS excess FROM (
  SELECT *, round_even(n * budget / cast(100 AS DOUBLE), 0) AS called, cast(ceil(n * budget / cast(100 AS DOUBLE)) AS BIGINT) AS rounded_up
  FROM (SELECT task, seed, count(*) AS n FROM t GROUP BY ALL), (SELECT unnest([0, 5, 10, 20, 40, 60, 80, 100]) AS budget))""",
    PAIRED, TEST,
)
add(
    "feature_spearman",
    f"""SELECT task, feature, {r('corr(a, b)')} AS spearman FROM (
  SELECT task, feature, rank() OVER (PARTITION BY task, feature ORDER BY value) + (count(*) OVER (PARTITION BY task, feature, value) - 1) / cast(2 AS DOUBLE) AS a,
    rank() OVER (PARTITION BY task, feature ORDER BY utility) + (count(*) OVER (PARTITION BY task, feature, utility) - 1) / cast(2 AS DOUBLE) AS b
  FROM (SELECT task, utility, unnest(['y', 'pred2d', 'cost', 'score']) AS feature, unnest([y, pred2d, cost, score]) AS value FROM ut)) GROUP BY task, feature""",
    PAIRED, UTIL, UT,
)
add(
    "conformer_control",
    f"""SELECT task, count(*) AS n, {r('avg(rotatable / cast(10 AS DOUBLE))')} AS difference, {r('avg((energy_min - (energy_min - rotatable / cast(10 AS DOUBLE)) > 0)::DOUBLE)')} AS gained
FROM manifest WHERE energy_min IS NOT NULL AND success AND rotatable < 9 GROUP BY task""",
    MANIFEST,
)
# --- splits
KEY = "('0x' || substr(md5('{s}:' || mol_id), 1, 8))::BIGINT"
ONE = "s0 AS (SELECT * FROM paired WHERE seed = 0)"
add("group_disjoint_check", "SELECT task, max(parts) AS most, count(*) AS groups FROM (SELECT task, group_key, count(DISTINCT split) AS parts FROM s0 GROUP BY ALL) GROUP BY task", PAIRED, ONE)
add(
    "hashed_random_split",
    f"""SELECT task, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split, count(*) AS n, cast(sum(mol_id) AS BIGINT) AS ids FROM (
  SELECT *, floor(n * cast(0.8 AS DOUBLE)) AS a, floor(n * cast(0.1 AS DOUBLE)) AS b FROM (
    SELECT task, mol_id, row_number() OVER (PARTITION BY task ORDER BY {KEY.format(s=11)}, mol_id) AS k, count(*) OVER (PARTITION BY task) AS n FROM s0)) GROUP BY ALL""",
    PAIRED, ONE,
)
add(
    "label_fraction_sample",
    f"""SELECT task, y, count(*) AS n, cast(sum(mol_id) AS BIGINT) AS ids FROM (
  SELECT task, y, mol_id, row_number() OVER (PARTITION BY task, y ORDER BY {KEY.format(s=5)}, mol_id) AS k, count(*) OVER (PARTITION BY task, y) AS n FROM s0 WHERE task_type = 'classification'
) WHERE k <= greatest(1, round_even(n * cast(0.25 AS DOUBLE), 0)) GROUP BY task, y""",
    PAIRED, ONE,
)
add(
    "hashed_folds",
    f"""SELECT task, {r('y')} AS y, (k - 1) % 5 AS fold, count(*) AS n, cast(sum(mol_id) AS BIGINT) AS ids FROM (
  SELECT task, y, mol_id, row_number() OVER (PARTITION BY task, y ORDER BY {KEY.format(s=1701)}, mol_id) AS k FROM s0 WHERE task_type = 'classification') GROUP BY ALL""",
    PAIRED, ONE,
)
add(
    "qcut_strata",
    f"""SELECT task, stratum, count(*) AS n, {r('min(y)')} AS low, {r('max(y)')} AS high FROM (
  SELECT task, y, cast(len(list_filter(list_distinct(e), lambda x: y > x AND x > l)) AS BIGINT) AS stratum FROM s0 JOIN (
    SELECT task, quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS e, min(y) AS l FROM s0 GROUP BY task) USING (task) WHERE task_type = 'regression') GROUP BY task, stratum""",
    PAIRED, ONE,
)
add(
    "dataset_card",
    f"""SELECT task, task_type, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
  {r('avg(y)')} AS y_mean, {r('stddev_samp(y)')} AS y_std, {r('min(y)')} AS y_min, {r('max(y)')} AS y_max FROM s0 GROUP BY task, task_type""",
    PAIRED, ONE,
)
add(
    "subsample_exact",
    f"SELECT task, count(*) AS n, cast(sum(mol_id) AS BIGINT) AS ids FROM (SELECT task, mol_id, row_number() OVER (PARTITION BY task ORDER BY {KEY.format(s=9)}, mol_id) AS k FROM s0) WHERE k <= 40 GROUP BY task",
    PAIRED, ONE,
)
# --- wrangling
add(
    "clean_dedup",
    """SELECT mol_id, n_chars, task || '_' || lpad((row_number() OVER (PARTITION BY task ORDER BY mol_id) - 1)::VARCHAR, 6, '0') AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY mol_id) AS k FROM items WHERE text IS NOT NULL) WHERE k = 1""",
    ITEMS,
)
add("column_fallback", "SELECT p_name AS item, cast(sum(p_size) AS BIGINT) AS target FROM part GROUP BY p_name")
add(
    "union_by_name",
    f"""SELECT nation::BIGINT AS nation, count(*) AS n, count(seg) AS segments, {r('sum(balance)')} AS balance FROM (
  SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS seg FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY nation""",
)
add("left_join_desc", f"SELECT p_brand, count(*) AS n, {r('sum(l_quantity)')} AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25 GROUP BY p_brand")
add("one_to_one_join", f"SELECT c_custkey AS key, {r('c_acctbal')} AS c_acctbal, {r('s_acctbal')} AS s_acctbal FROM customer JOIN supplier ON c_custkey = s_suppkey")
add("anti_join_missing", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
add("duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
add("keep_last", f"SELECT o_custkey, o_orderkey, {r('o_totalprice')} AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
add("null_key_groups", "SELECT failure_reason, count(*) AS n, failure_reason IS NULL AS dropped FROM manifest GROUP BY failure_reason", MANIFEST)
add(
    "rotatable_bins",
    f"""SELECT task, CASE WHEN rotatable <= 0 THEN 0 WHEN rotatable <= 2 THEN 1 WHEN rotatable <= 5 THEN 2 WHEN rotatable <= 8 THEN 3 ELSE 4 END::BIGINT AS bin, count(*) AS n,
  {r('avg(elapsed_sec)')} AS elapsed FROM manifest GROUP BY ALL""",
    MANIFEST,
)
add(
    "category_screen",
    f"""SELECT p_brand, metric, {r('gain')} AS gain, {CATEGORY} AS category FROM (
  SELECT *, CASE WHEN metric = 'AUROC' THEN b - a ELSE a - b END AS gain, CASE WHEN metric = 'AUROC' THEN (b - a) / 0.01::DOUBLE ELSE (a - b) / abs(a) / 0.02::DOUBLE END AS g FROM (
    SELECT p_brand, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand), (SELECT unnest(['MAE', 'AUROC']) AS metric))""",
)
add("md5_offset", "SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 8))::BIGINT % 100000 AS \"offset\" FROM part")
TOP = """tops AS (SELECT task, failure_reason, n FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, failure_reason) AS k FROM (SELECT task, failure_reason, count(*) AS n FROM manifest WHERE failure_reason IS NOT NULL GROUP BY ALL)) WHERE k = 1)"""
add("value_counts_top", "SELECT task, failure_reason, n FROM tops", MANIFEST, TOP)
add("dict_map_default", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY kind")
add("coerce_numeric", f"SELECT s, {r('max(try_cast(s AS DOUBLE))')} AS number, count(*) AS n FROM (SELECT regexp_extract(p_brand, '[0-9A-Z]+$') AS s FROM part) GROUP BY s")
add("task_type_inference", "SELECT task, CASE WHEN bool_and(y IN (0, 1)) THEN 'classification' ELSE 'regression' END AS kind FROM s0 GROUP BY task", PAIRED, ONE)
add(
    "conformer_qc",
    f"""SELECT task, q.n, {r('success')} AS success, {r('missing')} AS missing, {r('p95')} AS p95, failure_reason AS top_failure, success >= 0.95 AS passes FROM (
  SELECT task, count(*) AS n, avg(success::DOUBLE) AS success, avg((energy_min IS NULL)::DOUBLE) AS missing, quantile_cont(elapsed_sec, 0.95) AS p95 FROM manifest GROUP BY task) q LEFT JOIN tops USING (task)""",
    MANIFEST, TOP,
)
add(
    "cost_rollup",
    f"SELECT task, {r('avg(elapsed_sec)')} AS mean_elapsed, count(*) AS n, count(*) FILTER (success) AS selected, {r('count(*) FILTER (success) * avg(elapsed_sec) / 3600')} AS cpu_hours FROM manifest GROUP BY task",
    MANIFEST,
)
add(
    "pct_rank",
    f"""SELECT task, mol_id, {r('(rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / cast(2 AS DOUBLE)) / count(*) OVER (PARTITION BY task)')} AS share
FROM (SELECT task, mol_id, round(score, 2) AS s FROM t WHERE seed = 0)""",
    PAIRED, TEST,
)
add(
    "zscore",
    f"SELECT task, mol_id, {r('(score - m) / s')} AS z FROM t JOIN (SELECT task, avg(score) AS m, stddev_pop(score) AS s FROM paired WHERE seed = 0 AND split = 'train' GROUP BY task) USING (task) WHERE seed = 0",
    PAIRED, TEST,
)
# --- ensembles
add(
    "weighted_average",
    f"SELECT task, seed::BIGINT AS seed, mol_id, {r('sum(pred * w) / sum(w)')} AS pred, {r('any_value(y)')} AS y FROM (SELECT *, CASE member WHEN 'a2d' THEN 1 ELSE 3 END AS w FROM members WHERE split = 'val' AND member IN ('a2d', 'b3d')) GROUP BY task, seed, mol_id",
    MEMBERS,
)
add(
    "late_fusion_grid",
    f"""SELECT task, task_type, seed::BIGINT AS seed, step AS weight_step, 'MAE' AS metric, {r('m')} AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY round(m, 12), step) AS k FROM (
    SELECT task, task_type, seed, step, avg(abs(y - (pred2d + (pred3d - pred2d) * step / 20))) AS m FROM v, (SELECT unnest(range(0, 21)) AS step) WHERE task_type = 'regression' GROUP BY ALL)) WHERE k = 1""",
    PAIRED, VAL,
)
add(
    "best_single",
    f"""SELECT task, seed::BIGINT AS seed, member, metric, {r('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY CASE metric WHEN 'AUROC' THEN -value ELSE value END, member) AS k FROM (
  SELECT task, seed, member, 'AUROC' AS metric, AUROC AS value FROM ({auc('mc', 'task, seed, member', 'y', 'pred')})
  UNION ALL SELECT task, seed, member, 'MAE', avg(abs(y - pred)) FROM members WHERE split = 'val' AND task_type = 'regression' GROUP BY task, seed, member)) WHERE k = 1""",
    MEMBERS, "mc AS (SELECT * FROM members WHERE split = 'val' AND task_type = 'classification')",
)
# --- streams
add(
    "stream_resource_window",
    f"""SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS samples, {r('max(value)')} AS peak FROM events GROUP BY ALL""",
)
add(
    "first_known_values",
    f"""SELECT o_custkey, {r("arg_min(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 = 0)")} AS price, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) AS status FROM orders GROUP BY o_custkey""",
)
add("duplicate_key_means", f"SELECT p_brand, count(*) AS n, {r('avg(p_size)')} AS size, {r('avg(p_retailprice)')} AS price FROM part GROUP BY p_brand")
add("head_rows", f"SELECT task, seed::BIGINT AS seed, mol_id, {r('score')} AS score FROM t ORDER BY t.score DESC, mol_id, t.seed LIMIT 12", PAIRED, TEST)
add(
    "prefix_and_json",
    """SELECT lower(c_mktsegment) AS name, CASE WHEN c_mktsegment LIKE 'B%' THEN 'b-' || substr(c_mktsegment, 2) ELSE c_mktsegment END AS other,
  '{"' || lower(c_mktsegment) || '":' || count(*) || ',"all":1}' AS weights FROM customer GROUP BY c_mktsegment""",
)
add("multi_csv_concat", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
add("flexibility_score", f"SELECT task, {r('sum(rotatable + cast(0.05 AS DOUBLE) * length(task))')} AS flexibility, count(*) AS n FROM manifest GROUP BY task", MANIFEST)
# --- models
_COLS = ["cast(1 AS DOUBLE)", *CHEAP, *COSTLY, "y"]
add(
    "stacker_gram_sums",
    "SELECT task, task_type, seed::BIGINT AS seed, i, j, value FROM ("
    + " UNION ALL ".join(
        f"SELECT task, task_type, seed, {i}::BIGINT AS i, {j}::BIGINT AS j, {r(f'sum({_COLS[i]} * {_COLS[j]})')} AS value FROM modalities WHERE split = 'val' GROUP BY task, task_type, seed"
        for i in range(len(_COLS))
        for j in range(i, len(_COLS))
    )
    + ")",
    MODALITIES,
)
_P = clip("pred")
add(
    "mixture_em_step",
    f"""SELECT task, task_type, seed::BIGINT AS seed, member, {r('avg(r)')} AS weight, {r('sqrt(sum(r * e) / sum(r))')} AS deviation FROM (
  SELECT *, own / sum(own) OVER (PARTITION BY task, seed, mol_id) AS r FROM (
    SELECT *, CASE WHEN task_type = 'classification' THEN CASE WHEN y = 1 THEN {_P} ELSE 1 - {_P} END ELSE greatest(1e-300, exp(-e / (2 * s * s)) / s) END AS own FROM (
      SELECT *, sqrt(avg(e) OVER (PARTITION BY task, seed, member)) AS s FROM (SELECT *, (y - pred) * (y - pred) AS e FROM members JOIN (SELECT DISTINCT task, task_type FROM paired) USING (task) WHERE split = 'val'))))
GROUP BY task, task_type, seed, member""",
    MEMBERS,
)
add(
    "array_files",
    f"""SELECT vec_id, {r('list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE)))')} AS total, len(embedding)::BIGINT AS n FROM embeddings WHERE embedding IS NOT NULL""",
)
add("feature_cache", r"SELECT doc_id, length(text) AS size, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM documents")
