"""Linear and kernel models of many groups at once, from grouped sums of outer products.

Every fit is Newton's method on a penalised loss: tasks sum curvature-weighted outer products of their rows' features and
the gradient for each group, a grouped aggregate adds the tasks' sums, and the driver solves one small system for each group. A
square loss needs one turn. Rows are read in every turn and held nowhere; the driver holds matrices of the features' number,
never rows. Kernel models are linear in Nystroem features of a bounded sample of landmarks; with all rows as landmarks they are
the exact kernel models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.sources.tables import scratch_path

from .splits import hash_key
from .trees import GROUPS, _numbered, fill, grouping, matrix

Keys = Sequence[str]
#: Rows that a task puts together before it deals with them by group, and most rows of a group in one stored run.
TOGETHER, RUN = 1 << 17, 1 << 12
#: Penalties of the ridge that are tried; fixed values of the protocol.
PENALTIES = np.logspace(-4, 4, 17)


@dataclass
class Prepared:
    """Rows of all groups with what scales them: medians fill, then mean and deviation standardise.

    Rows are stored in runs of a group: its number `_g`, and arrays of labels `_y`, weights `_w`, items `_item`, and of features `_x`, one row's after another's.
    """

    keys: list[str]
    features: list[str]
    groups: list[tuple]
    rows: DataFrame
    n: np.ndarray
    ones: np.ndarray
    mean_y: np.ndarray
    medians: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    varies: np.ndarray
    unit: np.ndarray | None = None

    def light(self) -> Prepared:
        """Without the DataFrame, which tasks cannot have."""
        return replace(self, rows=None)

    def scaled(self, x: np.ndarray, group: np.ndarray | int) -> np.ndarray:
        return (fill(x, group, self.medians) - self.mean[group]) / self.deviation[group]


def prepare(df: DataFrame, keys: Keys, features: Sequence[str], label: str, item: str | None = None, weight: str | None = None) -> Prepared:
    """Writes the rows with a label, numbered by group, and takes each group's sums of them, without the rows' weights.

    NULL and NaN features count as their group's (approximate) median; a feature that does not vary has deviation 1. Rows
    without a label or with a NULL key are left out.
    """
    keys, features = list(keys), list(features)
    spark, d = df.sparkSession, len(features)
    value = [F.when(~F.isnan(c), c) for c in (F.col(f).cast("double") for f in features)]
    y = F.col(label).cast("double")
    rows = df.select(
        *keys, F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in value]).alias("_x"), F.when(~F.isnan(y), y).alias("_y"),
        (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("_item"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *[c.alias(f"_f{i}") for i, c in enumerate(value)],
    ).where(F.col("_y").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    facts = [F.count("*").alias("n"), F.sum("_y").alias("y"), F.count_if(F.col("_y") == 1).alias("ones")]
    for i in range(d):
        facts += [F.sum(f"_f{i}").alias(f"s{i}"), F.count(f"_f{i}").alias(f"k{i}"), F.percentile_approx(f"_f{i}", 0.5, 10_000).alias(f"m{i}")]
    known = sorted((r for r in rows.groupBy(*keys).agg(*facts).limit(GROUPS + 1).collect() if r.n), key=lambda r: tuple(r[k] for k in keys))
    if len(known) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    groups = [tuple(r[k] for k in keys) for r in known]
    pick = lambda s: np.array([[r[f"{s}{i}"] or 0.0 for i in range(d)] for r in known], float).reshape(len(known), d)
    n, medians = np.array([r.n for r in known], float), pick("m")
    mean = (pick("s") + (n[:, None] - pick("k")) * medians) / n[:, None]
    path = scratch_path(spark, "linear")
    _numbered(rows, keys, groups).where(F.col("_g").isNotNull()).select("_g", "_x", "_y", "_item", "_w").mapInArrow(packed, PACKED).write.parquet(path)
    rows = spark.read.schema(PACKED).parquet(path)
    out = Prepared(keys, features, groups, rows, n, np.array([r.ones for r in known], float), np.array([r.y for r in known], float) / n, medians, mean, np.ones_like(mean), np.zeros(mean.shape, bool))
    return standardised(out)


def standardised(p: Prepared) -> Prepared:
    """With the deviations about the means."""
    light = p.light()
    squares = grouped_sums(p.rows, len(p.groups), len(p.features), lambda g, x, y, w: (light.scaled(x, g) ** 2).sum(0)) if p.groups else np.zeros_like(p.mean)
    spread = np.sqrt(squares / np.maximum(1, p.n)[:, None])
    # what is left of a constant after rounding is no deviation
    varies = spread > 1e-12 * np.maximum(1, np.abs(p.mean))
    return replace(p, varies=varies, deviation=np.where(varies, spread, 1.0))


def of_runs(rows: DataFrame, features: Sequence[str], key: str, n_groups: int, complete: bool = False) -> Prepared:
    """As `prepare` gives, of rows that are stored in runs already; groups are numbers of the column `key`, and weights count in units of their group's mean.

    `complete` says that no feature is missing, neither here nor where the model predicts, so that no median is taken.
    """
    d = len(features)
    sums = grouped_sums(rows, n_groups, 3 + 2 * d, lambda g, x, y, w: np.concatenate([[len(y), (y == 1).sum(), w.sum()], np.nansum(x, axis=0), (~np.isnan(x)).sum(0)]))
    n, ones, weight, total, known = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3 : 3 + d], sums[:, 3 + d :]
    medians = np.zeros((n_groups, d))
    if not complete:
        value = [F.when(~F.isnan(F.col("_x")[i]), F.col("_x")[i]) for i in range(d)]
        for r in single(rows, d).groupBy("_g").agg(F.array(*[F.percentile_approx(v, 0.5, 10_000) for v in value]).alias("mid")).collect():
            medians[r._g] = [v or 0.0 for v in r.mid]
    size = np.maximum(1, n)
    mean = (total + (n[:, None] - known) * medians) / size[:, None]
    blank = np.ones_like(mean)
    return standardised(Prepared([key], list(features), [(g,) for g in range(n_groups)], rows, n, ones, np.zeros(n_groups), medians, mean, blank, blank > 0, np.where(n > 0, weight / size, 1.0)))


#: How rows are stored.
PACKED = "_g int, _x array<double>, _y array<double>, _w array<double>, _item array<string>"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows put into runs of at most RUN rows of a group."""
    for table in together(batches):
        group = table["_g"].to_numpy()
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(group))
        cuts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(starts, ends, strict=True)]).astype(np.int32)
        bounds = np.append(cuts, len(group)).astype(np.int32)
        d = len(table["_x"].flatten()) // len(group)
        lists = {c: pa.ListArray.from_arrays(bounds, table[c]) for c in ("_y", "_w", "_item")}
        yield pa.record_batch({"_g": table["_g"].take(pa.array(cuts)), "_x": pa.ListArray.from_arrays(bounds * d, table["_x"].flatten()), **lists})


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many batches, a group's side by side."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if held and (batch is None or n >= TOGETHER):
            table = pa.Table.from_batches(held)
            yield table.take(pa.array(grouping(table["_g"].to_numpy()))).combine_chunks().to_batches()[0]
            held, n = [], 0


def single(rows: DataFrame, d: int) -> DataFrame:
    """Stored runs as rows: `_g`, `_item` and `_x`."""
    one = F.transform("_y", lambda _, i: F.struct(F.get("_item", i).alias("_item"), F.slice("_x", i * d + 1, d).alias("_x")))
    return rows.select("_g", F.inline(one))


def grouped_sums(rows: DataFrame, n_groups: int, size: int, add: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each group the sum of `size` numbers that add(group, features, labels, weights) gives for some of its rows."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Groups, features (NaN where missing), labels and weights, so many at a time that they stay in a core's cache."""
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch["_y"].value_lengths().to_numpy()
            ends, y, w = np.cumsum(sizes), batch["_y"].flatten().to_numpy(), batch["_w"].flatten().to_numpy()
            group, x = np.repeat(batch["_g"].to_numpy(), sizes), matrix(batch["_x"], len(batch["_x"].flatten()) // len(y))
            at = 0
            for end in [*ends[np.flatnonzero(ends[:-1] // RUN < ends[1:] // RUN)], len(y)]:
                yield group[at:end], x[at:end], y[at:end], w[at:end]
                at = end

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for group, x, y, w in met(batches):
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(group)), strict=True):
                g = int(group[a])
                totals[g] = totals.get(g, 0.0) + add(g, x[a:b], y[a:b], w[a:b])
        for g, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"g": np.full(len(at), g, np.int32), "at": at.astype(np.int32), "v": total[at]})

    out = np.zeros((n_groups, size))
    found = rows.select("_g", "_x", "_y", "_w").mapInArrow(summed, "g int, at int, v double").groupBy("g", "at").agg(F.sum("v").alias("v")).toArrow()
    out[found["g"].to_numpy(), found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def unchanged(group: int, x: np.ndarray) -> np.ndarray:
    return x


#: Of a score and a label: loss, its slope and its curvature. Labels of classes are 0 and 1.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def square(score: np.ndarray, y: np.ndarray):
    return (score - y) ** 2 / 2, score - y, np.ones_like(y)


def logistic(score: np.ndarray, y: np.ndarray):
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    return np.logaddexp(0, score) - y * score, p - y, p * (1 - p)


def squared_hinge(score: np.ndarray, y: np.ndarray):
    sign = 2 * y - 1
    short = np.maximum(0, 1 - sign * score)
    return short**2 / 2, -sign * short, (short > 0).astype(float)


def squared_epsilon(epsilon: float) -> Loss:
    def loss(score: np.ndarray, y: np.ndarray):
        over = np.sign(score - y) * np.maximum(0, np.abs(score - y) - epsilon)
        return over**2 / 2, over, (over != 0).astype(float)

    return loss


@dataclass
class Linear:
    """A fitted model of each group: the features' map, weights and an intercept. `p` tells how to scale and which groups there are."""

    p: Prepared
    weights: np.ndarray
    intercept: np.ndarray
    probability: bool = False
    features: Callable[[int, np.ndarray], np.ndarray] = unchanged
    penalty: np.ndarray | None = None
    turns: int = 0

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Adds `name`: the score, or the probability of class 1; NULL in unknown groups and where the fit is undefined."""
        p = self.p
        kept = df.sparkSession.sparkContext.broadcast(replace(self, p=p.light()))

        @F.arrow_udf("double")
        def score(group: pa.Array, x: pa.Array) -> pa.Array:
            m = kept.value
            if m.features is unchanged:
                at = np.flatnonzero(group.is_valid().to_numpy(zero_copy_only=False))
                numbers, rows = group.drop_null().to_numpy(), matrix(x, len(m.p.features))[at]
                out = np.full(len(group), np.nan)
                out[at] = (m.p.scaled(rows, numbers) * m.weights[numbers]).sum(1) + m.intercept[numbers]
                return finished(m, out)
            numbers, out, rows = group.fill_null(-1).to_numpy(zero_copy_only=False), np.full(len(group), np.nan), matrix(x, len(m.p.features))
            for g in np.unique(numbers[numbers >= 0]).tolist():
                at = np.flatnonzero(numbers == g)
                z = m.p.scaled(rows[at], g)
                out[at] = m.features(g, z) @ m.weights[g] + m.intercept[g]
            return finished(m, out)

        def finished(m: Linear, out: np.ndarray) -> pa.Array:
            if m.probability:
                out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            return pa.array(out, mask=np.isnan(out))

        x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in p.features])
        return _numbered(df, p.keys, p.groups).withColumn(name, score("_g", x)).select(*[c for c in df.columns if c != name], name)


def newton(
    p: Prepared, loss: Loss, penalty: float, intercept: bool = True, balanced: bool = False, width: int | None = None,
    features: Callable[[int, np.ndarray], np.ndarray] = unchanged, turns: int = 40, close: float = 1e-9,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights, intercepts and turns taken: minimises penalty / 2 |w|^2 + the sum of losses in every group.

    With `balanced` the rows of each class weigh as much as half of all; a group of one class then has no fit (NaN). A step
    that makes the loss greater is halved.
    """
    G, D = len(p.groups), width or len(p.features)
    light = p.light()
    one_class = (p.ones == 0) | (p.ones == p.n)
    row_weight = np.stack([p.n / np.maximum(1, 2 * (p.n - p.ones)), p.n / np.maximum(1, 2 * p.ones)], 1)
    ridge = np.full(D + 1, penalty)
    ridge[D] = 0.0
    at, step = np.zeros((G, D + 1)), np.zeros((G, D + 1))
    best = np.full(G, np.inf)
    open_ = np.ones(G, bool) if not balanced else ~one_class
    taken = 0
    while open_.any() and taken < turns:
        taken += 1
        now = at + step

        def add(g: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, now=now, open_=open_) -> np.ndarray:
            if not open_[g]:
                return np.zeros(1 + (D + 1) * (D + 2))
            z = np.column_stack([features(g, light.scaled(x, g)), np.full(len(x), float(intercept))])
            value, slope, curve = loss(z @ now[g], y)
            w = w if light.unit is None else w / light.unit[g]
            w = w * row_weight[g][(y == 1).astype(int)] if balanced else w
            return np.concatenate([[(w * value).sum()], z.T @ (w * slope), ((z * (w * curve)[:, None]).T @ z).ravel()])

        sums = grouped_sums(p.rows, G, 1 + (D + 1) * (D + 2), add)
        for g in np.flatnonzero(open_):
            whole = sums[g, 0] + (ridge * now[g] ** 2).sum() / 2
            if whole > best[g] * (1 + 1e-12) + 1e-12:
                step[g] /= 2
                if np.abs(step[g]).max() < close:
                    open_[g] = False
                continue
            at[g], best[g] = now[g], whole
            slope = sums[g, 1 : D + 2] + ridge * at[g]
            curve = sums[g, D + 2 :].reshape(D + 1, D + 1) + np.diag(ridge)
            step[g] = -np.linalg.lstsq(curve, slope, rcond=1e-13)[0]
            if loss is square:
                at[g] += step[g]
            open_[g] = loss is not square and np.abs(step[g]).max() > close * max(1.0, np.abs(at[g]).max())
    weights, shift = at[:, :D], at[:, D]
    if balanced:
        weights, shift = np.where(one_class[:, None], np.nan, weights), np.where(one_class, np.nan, shift)
    return weights, shift, taken


def balanced_logistic(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y", strength: float = 1.0) -> Linear:
    """The logistic model of standardised features, |w|^2 / 2 + strength times the class-balanced log loss; no fit with one class."""
    p = prepare(df, keys, features, label)
    weights, shift, turns = newton(p, logistic, 1 / strength, balanced=True)
    return Linear(p, weights, shift, probability=True, turns=turns)


def gram_sums(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y") -> DataFrame:
    """keys, i, j and value: sums of products of features (numbered from 1; the label is the last), i <= j; 0 stands for 1."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    sums = [(i, j, F.sum(cols[i] * cols[j])) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.groupBy(*keys).agg(*[c.alias(f"v{i}_{j}") for i, j, c in sums])
    long = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}_{j}").alias("value")) for i, j, _ in sums])
    return wide.select(*keys, F.inline(long))


def ridge_cv(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y", penalties: Sequence[float] = PENALTIES) -> Linear:
    """Ridge regression of standardised features; the penalty with the least leave-one-out error of the group, the first on ties.

    One pass sums outer products; all penalties are solved from them. The second sums squared leave-one-out errors, which
    follow from a row's own leverage: (y - fit) / (1 - 1 / n - z' (G + a I)^-1 z).
    """
    p = prepare(df, keys, features, label)
    G, d, penalties = len(p.groups), len(p.features), np.asarray(penalties, float)
    light = p.light()

    def outer(g: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = light.scaled(x, g)
        return np.concatenate([(z.T @ z).ravel(), z.T @ (y - light.mean_y[g])])

    sums = grouped_sums(p.rows, G, d * d + d, outer) if G else np.zeros((0, d * d + d))
    solved = []
    for g in range(G):
        values, vectors = np.linalg.eigh(sums[g, : d * d].reshape(d, d))
        shrink = 1 / (np.maximum(values, 0)[:, None] + penalties)
        solved.append((vectors, shrink, vectors @ (shrink * (vectors.T @ sums[g, d * d :])[:, None])))

    def left_out(g: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        vectors, shrink, weights = solved[g]
        z = light.scaled(x, g)
        leverage = 1 / light.n[g] + (z @ vectors) ** 2 @ shrink
        rest = y[:, None] - light.mean_y[g] - z @ weights
        return ((rest / np.maximum(1e-12, 1 - leverage)) ** 2).sum(0)

    errors = grouped_sums(p.rows, G, len(penalties), left_out) if G else np.zeros((0, len(penalties)))
    chosen = errors.argmin(1) if G else np.zeros(0, int)
    weights = np.array([solved[g][2][:, chosen[g]] for g in range(G)]).reshape(G, d)
    return Linear(p, weights, p.mean_y.copy(), penalty=penalties[chosen] if G else np.zeros(0))


@dataclass
class Nystroem:
    """Features in which the RBF kernel is the inner product: exact between landmarks, approximate elsewhere."""

    landmarks: list[np.ndarray]
    root: list[np.ndarray]
    gamma: np.ndarray
    width: int

    def kernel(self, g: int, x: np.ndarray) -> np.ndarray:
        marks = self.landmarks[g]
        far = (x**2).sum(1)[:, None] + (marks**2).sum(1) - 2 * x @ marks.T
        return np.exp(-self.gamma[g] * np.maximum(0, far))

    def __call__(self, g: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        mapped = self.kernel(g, x) @ self.root[g]
        out[:, : mapped.shape[1]] = mapped
        return out


def nystroem(p: Prepared, landmarks: int = 128, gamma: float | None = None, seed: int = 0) -> Nystroem:
    """At most `landmarks` different rows of every group, those of the lowest hashes of their items; gamma is 1 / (features * variance) unless given."""
    spark, G, d = p.rows.sparkSession, len(p.groups), len(p.features)
    fields = ", ".join(["_g int", "_part double"])
    shares = F.broadcast(spark.createDataFrame([(g, min(1.0, float(4 * landmarks / p.n[g]))) for g in range(G)], fields))
    # a few times too many by a threshold of the hash, then the lowest of them
    drawn = single(p.rows, d).withColumn("_h", hash_key(seed, F.coalesce("_item", F.col("_x").cast("string"))))
    drawn = drawn.join(shares, "_g").where(F.col("_h") < F.col("_part") * float(1 << 32)).select("_g", "_h", "_x").distinct()
    order = Window.partitionBy("_g").orderBy("_h", "_x")
    rows = drawn.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= landmarks).drop("_at").orderBy("_g", "_h", "_x").toArrow().to_batches()
    found: list[list] = [[] for _ in range(G)]
    for batch in rows:
        group = batch["_g"].to_numpy()
        z = p.scaled(matrix(batch["_x"], d), group)
        for g in np.unique(group).tolist():
            found[g].append(z[group == g])
    marks = [np.unique(np.concatenate(f), axis=0) if f else np.zeros((0, d)) for f in found]
    varies = p.varies.sum(1) / d  # of standardised features the variance is the share of those that vary
    out = Nystroem(marks, [], np.array([gamma or 1 / (d * max(v, 1e-12)) for v in varies]), landmarks)
    for g in range(G):
        values, vectors = np.linalg.eigh(out.kernel(g, marks[g]))
        keep = values > 1e-12 * max(1.0, values.max(initial=0))
        out.root.append(vectors[:, keep] / np.sqrt(values[keep]))
    return out


def kernel_ridge(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y", penalty: float = 1.0, landmarks: int = 128, gamma: float | None = None, item: str | None = "mol_id") -> Linear:
    """Ridge regression in the RBF kernel's space, without an intercept."""
    p = prepare(df, keys, features, label, item)
    f = nystroem(p, landmarks, gamma)
    weights, shift, turns = newton(p, square, penalty, intercept=False, width=f.width, features=f)
    return Linear(p, weights, shift, features=f, turns=turns)


def kernel_classifier(df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y", strength: float = 10.0, landmarks: int = 128, gamma: float | None = None, item: str | None = "mol_id") -> Linear:
    """A support vector machine with an RBF kernel: |w|^2 / 2 + strength times the class-balanced squared hinge; predicts its score."""
    p = prepare(df, keys, features, label, item)
    f = nystroem(p, landmarks, gamma)
    weights, shift, turns = newton(p, squared_hinge, 1 / strength, balanced=True, width=f.width, features=f)
    return Linear(p, weights, shift, features=f, turns=turns)


def kernel_regressor(
    df: DataFrame, keys: Keys, features: Sequence[str], label: str = "y", strength: float = 10.0, epsilon: float = 0.1, landmarks: int = 128, gamma: float | None = None, item: str | None = "mol_id"
) -> Linear:
    """Support vector regression with an RBF kernel: errors up to epsilon are free, greater ones cost their square."""
    p = prepare(df, keys, features, label, item)
    f = nystroem(p, landmarks, gamma)
    weights, shift, turns = newton(p, squared_epsilon(epsilon), 1 / strength, width=f.width, features=f)
    return Linear(p, weights, shift, features=f, turns=turns)


def decision(score: str | Column) -> Column:
    """1 for scores of 0 or more."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNotNull(), (c >= 0).cast("double"))
