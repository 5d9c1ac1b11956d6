"""Connected components by alternating stars, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u is hung on the lowest of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its neighbours below it are hung on the lowest of these."""
    low = _lowest(e)
    rest = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label (the lowest node it is connected with) for every node of the edges (a, b); labels included.

    Edges are aggregated by their lower end before anything is joined, so a node with very many edges is one row for
    each map task. Rounds grow with the logarithm of a component's diameter.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, turn, last = scratch.keep(e, f"{name}0"), 0, None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, turn = state, turn + 1
        e = scratch.keep(_small_star(_large_star(e)), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
