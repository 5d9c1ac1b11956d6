"""Model fitting with MLlib: experts, routers, rankers, stackers. Numbers are MLlib's own; no other library's are matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .splits import folds, hash_key

#: name: (classifier, regressor)
KINDS = {
    "boosted": (
        lambda s: GBTClassifier(maxIter=40, maxDepth=5, stepSize=0.1, seed=s),
        lambda s: GBTRegressor(maxIter=40, maxDepth=5, stepSize=0.1, seed=s),
    ),
    "forest": (
        lambda s: RandomForestClassifier(numTrees=100, minInstancesPerNode=4, seed=s),
        lambda s: RandomForestRegressor(numTrees=100, minInstancesPerNode=4, seed=s),
    ),
    "linear": (lambda s: LogisticRegression(regParam=1e-3), lambda s: LinearRegression(regParam=1e-3)),
}


def expert(kind: str, task_type: str, features: Sequence[str], label: str = "y", seed: int = 0, weight: str | None = None) -> Pipeline:
    """Median imputation, scaling without centring, and the model; missing values may be NULL or NaN."""
    filled = [f"{f}__filled" for f in features]
    model = KINDS[kind][task_type != "classification"](seed).setLabelCol(label).setFeaturesCol("__scaled")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__features"),
            StandardScaler(inputCol="__features", outputCol="__scaled", withMean=False),
            model,
        ]
    )


def predict(model, df: DataFrame, task_type: str, name: str = "pred") -> DataFrame:
    """The probability of class 1, or the predicted value."""
    out = model.transform(df)
    value = vector_to_array("probability")[1] if task_type == "classification" else F.col("prediction")
    return out.withColumn(name, value).select(*df.columns, name)


def out_of_fold(df: DataFrame, kind: str, task_type: str, features: Sequence[str], n: int = 5, seed: int = 0, item: str = "mol_id", label: str = "y") -> DataFrame:
    """Each row's prediction by a model that has not seen its fold; folds are by class in classification."""
    dealt = _dealt(df, n, seed, item, label, task_type)
    out = None
    for k in range(n):
        model = expert(kind, task_type, features, label, seed).fit(dealt.where(F.col("fold") != k))
        part = predict(model, dealt.where(F.col("fold") == k), task_type)
        out = part if out is None else out.unionByName(part)
    return out


def _dealt(df: DataFrame, n: int, seed: int, item: str, label: str, task_type: str) -> DataFrame:
    if task_type == "classification":
        return folds(df, [], n, seed + 1701, item, label)
    return df.withColumn("fold", (hash_key(seed + 1701, F.col(item)) % n).cast("int"))


def pairwise_rows(df: DataFrame, keys: Sequence[str], gain: str, features: Sequence[str], partners: int = 4, margin: float = 0.0, seed: int = 0, item: str = "mol_id") -> DataFrame:
    """Differences of features between items of a group that are drawn as partners, labelled by which gains more.

    Every item meets `partners` others, found at hashed places; `weight` is the difference in gain.
    """
    keys = list(keys)
    placed = running(df.withColumn("_key", hash_key(seed, F.col(item)).cast("double")), keys, "_key", {"_at": F.lit(1).cast("long")}, ties=[item])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    left = placed.join(sizes, keys).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(partners))))
    left = left.withColumn("_other", (F.col("_at") - 1 + F.col("_turn") * 7919) % F.col("_n") + 1)
    right = placed.select(*keys, F.col("_at").alias("_other"), F.col(gain).alias("_gain2"), *[F.col(f).alias(f"_{f}2") for f in features])
    pairs = left.join(right, [*keys, "_other"]).withColumn("_d", F.col(gain) - F.col("_gain2")).where(F.abs("_d") > margin)
    return pairs.select(*keys, *[(F.col(f) - F.col(f"_{f}2")).alias(f) for f in features], (F.col("_d") > 0).cast("double").alias("y"), F.abs("_d").alias("weight"))


def pairwise_ranker(pairs: DataFrame, features: Sequence[str]):
    """An elastic-net logistic model of which of two items gains more; its linear score ranks items."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="__scaled"),
            LogisticRegression(labelCol="y", featuresCol="__scaled", weightCol="weight", regParam=1e-3, elasticNetParam=0.05, fitIntercept=False),
        ]
    ).fit(pairs)
