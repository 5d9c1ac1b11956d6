"""Routers that learn which items gain from the costly predictor, by six objectives, all groups at once.

Out of fold a row trains the models of every other fold. It is stored, ordered and read once: its targets are arrays with a
number for each fold, and its places among the rows of each training set follow from one order and running counts by fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.sources.tables import written

from .linear import PACKED, Linear, logistic, newton, of_runs, packed
from .ordered import by_value, running
from .splits import hash_key
from .trees import GROUPS, _numbered, extra_trees

Keys = Sequence[str]
#: Names of the objectives; fixed values of the protocol.
OBJECTIVES = ("R0_raw_utility", "R1_binary", "R2_margin_binary", "R3_three_class", "R4_pairwise_margin_weighted", "R5_rank_regression")
#: A margin binary fit needs so many rows beyond the margin.
LEAST = 16


#: How far apart partners are in the hashed order, and places that a task pairs at a time.
APART, BLOCK = 7919, 1 << 17


def fold_targets(df: DataFrame, keys: Keys, fold: str, n_folds: int, gain: str, margin_share: float = 0.25) -> DataFrame:
    """Adds `_margin` and `_rank`, arrays with a number for each fold's training set, the rows of all other folds: the margin (a share
    of its gains' deviation) and the gain's average rank as a share of its gains. Rows without a gain or a fold are left out."""
    keys = list(keys)
    df = df.where(F.col(gain).isNotNull() & F.col(fold).isNotNull())
    inside = [F.when(F.col(fold) != k, F.col(gain)) for k in range(n_folds)]
    facts = df.groupBy(*keys).agg(
        F.array(*[F.greatest(F.lit(1e-12), margin_share * F.stddev_pop(c)) for c in inside]).alias("_margin"), F.array(*[F.count(c) for c in inside]).alias("_count")
    )
    ranks = by_value(df, keys, gain, {f"_n{k}": (F.col(fold) != k).cast("long") for k in range(n_folds)})
    rank = lambda k: F.try_divide(F.col(f"_n{k}_to") - F.col(f"_n{k}") + (F.col(f"_n{k}") + 1) / 2, F.col("_count")[k])
    ranks = ranks.join(F.broadcast(facts), keys).select(*keys, gain, "_margin", F.array(*map(rank, range(n_folds))).alias("_rank"))
    return df.join(ranks, [*keys, gain])


def targets(df: DataFrame, keys: Keys, gain: str, margin_share: float = 0.25) -> DataFrame:
    """Adds the margin (a share of the gains' deviation in the group) and each objective's target: t0, t1, t2, t3 and t5."""
    rows = fold_targets(df.withColumn("_fold", F.lit(-1)), keys, "_fold", 1, gain, margin_share)
    rows = rows.withColumns({"margin": F.col("_margin")[0], "t5": F.col("_rank")[0]}).drop("_fold", "_margin", "_rank")
    u, m = F.col(gain), F.col("margin")
    return rows.withColumns({"t0": u.cast("double"), "t1": (u > 0).cast("int"), "t2": beyond(u, m), "t3": three_class(u, m)})


def beyond(u: Column, m: Column) -> Column:
    """Whether there is a gain, of those beyond the margin."""
    return F.when(F.abs(u) > m, (u > m).cast("int"))


def three_class(u: Column, m: Column) -> Column:
    return F.when(u > m, 1).when(u < -m, -1).otherwise(0)


def fold_pairs(rows: DataFrame, fold: str, sizes: np.ndarray, margins: np.ndarray, gain: str, features: Sequence[str], partners: int = 4, seed: int = 0, item: str = "mol_id") -> DataFrame:
    """Differences of features between items of a training set that are drawn as partners, as `pairwise_rows` draws them, stored in runs as linear models read them.

    rows have the group's number `_g`; a training set's number is that times the folds plus the fold that is left out. sizes and margins are arrays by group and
    fold; pairs within the margin are left out. Rows are ordered once for all training sets; a task gets a block of places and
    those that their partners have, which follow at fixed distances.
    """
    n_folds, d, spark = sizes.shape[1], len(features), rows.sparkSession
    rows = rows.select("_g", F.col(fold).alias("_own"), F.col(item).alias("_item"), F.col(gain).cast("double").alias("_u"), *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, f in enumerate(features)])
    counts = {"_at": F.lit(1).cast("long")} | {f"_c{k}": (F.col("_own") == k).cast("long") for k in range(n_folds)}
    placed = running(rows.withColumn("_key", hash_key(seed, F.col("_item")).cast("double")), ["_g"], "_key", counts, ties=["_item"])
    of = F.broadcast(spark.createDataFrame([(g, [int(n) for n in row]) for g, row in enumerate(sizes)], "_g int, _sizes array<long>"))
    placed = placed.join(of, "_g").withColumn("_k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("_own"))))
    at = F.col("_at") - F.array(*[F.col(f"_c{k}") for k in range(n_folds)])[F.col("_k")] - 1
    placed = placed.select((F.col("_g") * n_folds + F.col("_k")).alias("_n"), at.alias("_at"), F.col("_sizes")[F.col("_k")].alias("_size"), "_u", *[f"_x{i}" for i in range(d)])
    block = lambda c: F.floor(c / BLOCK).cast("int")
    asked = [block(F.col("_at")), *[block(F.pmod(F.col("_at") - turn * APART, F.col("_size"))) for turn in range(1, partners + 1)]]
    placed = placed.withColumn("_block", F.explode(F.array_distinct(F.array(*asked)))).drop("_size")
    kept = spark.sparkContext.broadcast((sizes.ravel(), margins.ravel()))

    def paired(key: tuple, table: pa.Table) -> pa.Table:
        sizes, margins = kept.value
        n, block = key[0].as_py(), key[1].as_py()
        at = table["_at"].to_numpy()
        by = np.argsort(at)
        at, u = at[by], table["_u"].to_numpy()[by]
        x = np.stack([table[f"_x{i}"].to_numpy()[by] for i in range(d)], 1)
        mine = np.flatnonzero(at // BLOCK == block)
        found = []
        for turn in range(1, partners + 1):
            other = np.searchsorted(at, (at[mine] + turn * APART) % sizes[n])
            gap = u[mine] - u[other]
            # as in SQL, what is no number is above all
            met = np.flatnonzero(~(np.abs(gap) <= margins[n]))
            found.append((x[mine[met]] - x[other[met]], (~(gap[met] <= 0)).astype(float), np.abs(gap[met])))
        x, y, w = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_batches(packed([pa.record_batch({"_g": np.full(len(y), n, np.int32), "_x": lists(x), "_y": y, "_w": w, "_item": pa.nulls(len(y), pa.string())})]), store)

    lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d, x.ravel())
    number = pa.list_(pa.float64())
    store = pa.schema({"_g": pa.int32(), "_x": number, "_y": number, "_w": number, "_item": pa.list_(pa.string())})
    return placed.groupBy("_n", "_block").applyInArrow(paired, PACKED)


def pairwise_scores(
    train: DataFrame, rows: DataFrame, keys: Keys, fold: str, n_folds: int, features: Sequence[str], gain: str, name: str, partners: int = 4, seed: int = 0, penalty: float = 0.1, item: str = "mol_id", complete: bool = False
) -> DataFrame:
    """Adds `name`: the linear score of a logistic model of which of two items gains more, pairs within the margin left out and the others
    weighted by how far they are apart. A group without such pairs scores 0. train has `_margin`; models are fitted on all folds but the row's."""
    keys = list(keys)
    found = train.groupBy(*keys).agg(F.first("_margin").alias("_margin"), F.array(*[F.count_if(F.col(fold) != k) for k in range(n_folds)]).alias("_sizes")).limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    found = sorted(found, key=lambda r: tuple(r[k] for k in keys))
    groups = [tuple(r[k] for k in keys) for r in found]
    numbers = lambda df: _numbered(df, keys, groups)
    sizes, margins = (np.array([r[c] for r in found], kind).reshape(len(found), n_folds) for c, kind in (("_sizes", np.int64), ("_margin", float)))
    pairs = written(fold_pairs(numbers(train), fold, sizes, margins, gain, features, partners, seed, item), "pairs")
    p = of_runs(pairs, features, "_n", sizes.size, complete)
    p.mean[:] = 0.0  # a difference's sign matters
    weights, shift, _ = newton(p, logistic, penalty, intercept=False)
    asked = numbers(rows).withColumn("_n", F.when(F.col(fold).between(0, n_folds - 1), F.col("_g") * n_folds + F.col(fold)).cast("int")).drop("_g")
    return Linear(p, weights, shift).predict(asked, name).select(*rows.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def objective_scores(
    train: DataFrame, rows: DataFrame, keys: Keys, features: Sequence[str], gain: str = "utility", trees: int = 100, depth: int = 12, margin_share: float = 0.25, seed: int = 0, item: str = "mol_id"
) -> DataFrame:
    """rows with a score of each objective, fitted on train: higher scores ask for the costly predictor first.

    R0 the gain itself by a forest; R1 whether there is a gain; R2 the same beyond the margin, rows within it left out; R3 the chance of a
    gain beyond the margin less that of a loss; R4 a pairwise ranking; R5 the gain's rank. R2 is 0 where fewer than 16 rows lie beyond the
    margin or all on one side, R3 where all rows are of one class. A group that train lacks has NULL scores, but R4 0.
    """
    return _scores(train.withColumn("_fold", F.lit(-1)), rows.withColumn("_fold", F.lit(0)), keys, 1, features, gain, trees, depth, margin_share, seed, item)


def out_of_fold_scores(
    df: DataFrame, keys: Keys, fold: str, n_folds: int, features: Sequence[str], gain: str = "utility", trees: int = 100, depth: int = 12, margin_share: float = 0.25, seed: int = 0, item: str = "mol_id"
) -> DataFrame:
    """df with every objective's score by models that were fitted on the other folds; folds are numbered from 0, all are fitted together."""
    rows = df.withColumn("_fold", F.col(fold).cast("int"))
    return _scores(rows, rows, keys, n_folds, features, gain, trees, depth, margin_share, seed, item)


def _scores(train: DataFrame, rows: DataFrame, keys: Keys, n_folds: int, features: Sequence[str], gain: str, trees: int, depth: int, margin_share: float, seed: int, item: str) -> DataFrame:
    """Every objective's score of rows, fitted for each `_fold` on the rows of train that have another one; without `_fold`."""
    keys, features, folds = list(keys), list(features), range(n_folds)
    gone = F.lit(False)
    for f in features:
        gone = gone | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    complete = all(not df.agg(F.max(gone)).first()[0] for df in ([rows] if train is rows else [train, rows]))
    t = train.select(*dict.fromkeys([*keys, "_fold", item, *features, gain]))
    t = written(fold_targets(t, keys, "_fold", n_folds, gain, margin_share), "targets")
    u, m = F.col(gain), F.col("_margin")
    view = lambda k, name, c: ({"_fold": k, "objective": name}, F.when(F.col("_fold") != k, c))
    of_values = [view(k, n, c) for k in folds for n, c in (("r0", u.cast("double")), ("r5", F.col("_rank")[k]))]
    of_classes = [view(k, n, c) for k in folds for n, c in (("r1", (u > 0).cast("int")), ("r2", beyond(u, m[k])), ("r3", three_class(u, m[k])))]
    options = dict(trees=trees, depth=depth, seed=seed, complete=complete)
    values = extra_trees(t, [*keys, "_fold", "objective"], features, None, views=of_values, **options)
    classes = extra_trees(t, [*keys, "_fold", "objective"], features, None, [-1, 0, 1], views=of_classes, **options)
    for name, forest in (("r0", values), ("r5", values), ("r1", classes), ("r2", classes), ("r3", classes)):
        rows = forest.predict(rows.withColumn("objective", F.lit(name)), f"_{name}").drop("objective")
    # of each training set the rows that gain or lose beyond the margin
    count = lambda c: F.array(*[F.count_if((F.col("_fold") != k) & c(k)) for k in folds])
    facts = t.groupBy(*keys).agg(count(lambda k: F.lit(True)).alias("_all"), count(lambda k: u > m[k]).alias("_up"), count(lambda k: u < -m[k]).alias("_down"))
    mine = {c: F.get(c, F.col("_fold")) for c in ("_all", "_up", "_down")}
    rows = rows.join(F.broadcast(facts), keys, "left").withColumns({c: F.when(mine["_all"] > 0, of) for c, of in mine.items()})
    sides = (F.col("_up") > 0).cast("int") + (F.col("_down") > 0).cast("int")
    kinds = sides + (F.col("_all") > F.col("_up") + F.col("_down")).cast("int")
    less = lambda c: F.col(c)[2] - F.col(c)[0]
    zero = F.lit(0.0)
    scores = {
        "R0_raw_utility": F.col("_r0"),
        "R1_binary": less("_r1"),
        "R2_margin_binary": F.when((F.col("_up") + F.col("_down") < LEAST) | (sides < 2), zero).otherwise(less("_r2")),
        "R3_three_class": F.when(kinds < 2, zero).otherwise(less("_r3")),
        "R5_rank_regression": F.col("_r5"),
    }
    rows = rows.withColumns(scores).drop("_r0", "_r1", "_r2", "_r3", "_r5", "_all", "_up", "_down")
    return pairwise_scores(t, rows, keys, "_fold", n_folds, features, gain, "R4_pairwise_margin_weighted", seed=seed, item=item, complete=complete).drop("_fold")
