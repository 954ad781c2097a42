"""Numbers that describe graphs, responses and selections, and orders to show nodes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.scores import numbered
from twinsieve.functions.vectors import distance, dot, norm


def _summary(c: str) -> list[Column]:
    return [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def sparse_summary(edges: DataFrame, n: int) -> DataFrame:
    """One row: the values of the entries of a graph over n nodes, their number and their share of all pairs."""
    return edges.where("w <> 0").agg(*_summary("w"), F.count("*").alias("nnz"), (F.count("*") / float(max(n * n, 1))).alias("density"))


def response_stats(rows: DataFrame) -> DataFrame:
    """One row: mean, deviation and range of the values of rows(i, v), and mean and deviation of the rows' norms."""
    values = rows.select(F.explode("v").alias("x")).agg(*_summary("x"))
    norms = rows.select(norm(F.col("v")).alias("n")).agg(F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"))
    return values.crossJoin(norms)


def regularisation(edges: DataFrame, points: DataFrame, least: float = 1e-8) -> DataFrame:
    """One row: the trace of Y' L Y for points(i, v) under the normed Laplacian of the graph among them."""
    inner = edges.join(points.select("i"), "i", "left_semi").join(points.select(F.col("i").alias("j")), "j", "left_semi")
    degree = inner.groupBy("i").agg(F.sum("w").alias("d"))
    scaled = points.join(degree, "i").select("i", F.transform("v", lambda x: x / F.sqrt(F.greatest("d", F.lit(least)))).alias("u"))
    cross = inner.join(scaled, "i").join(scaled.select(F.col("i").alias("j"), F.col("u").alias("t")), "j").agg(F.coalesce(F.sum(F.col("w") * dot(F.col("u"), F.col("t"))), F.lit(0.0)).alias("cross"))
    own = points.agg(F.sum(dot(F.col("v"), F.col("v"))).alias("own"))
    return own.crossJoin(cross).select((F.col("own") - F.col("cross")).alias("regularisation"))


def selection_summary(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: how many are selected, and the mean and range of their graph scores."""
    return selected.select("i").join(scores.select("i", "score"), "i").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


def ranked_for(centre: list[float], features: DataFrame, scores: DataFrame, weight: float = 0.1) -> DataFrame:
    """(i, value, rank): distance to a centre less the weighed graph score, the least first, ties by i."""
    at = F.array(*[F.lit(float(x)) for x in centre])
    rows = features.join(scores.select("i", "score"), "i", "left").select("i", (distance(F.col("v"), at) - weight * F.coalesce("score", F.lit(0.0))).alias("value"))
    return numbered(rows, [F.col("value"), F.col("i")], "k").select("i", "value", (F.col("k") + 1).alias("rank"))


def node_order(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(i, place) in the order of the named columns and of i."""
    return numbered(nodes, [*map(F.col, by), F.col("i")], "place").select("i", "place")


def shown(order: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of (i, place), evenly spread over the places."""
    n = order.count()
    if n <= most:
        return order
    spread = order.sparkSession.range(most).select(F.floor(F.col("id") * F.lit((n - 1) / max(most - 1, 1))).alias("place")).distinct()
    return order.join(F.broadcast(spread), "place", "left_semi")


def log_scaled(values: DataFrame, column: str = "x") -> DataFrame:
    """values with log1p(x / q10), cut at that of q99; both are percentiles of the positive values."""
    q = values.where(F.col(column) > 0).agg(F.percentile(column, F.lit(0.1)).alias("low"), F.percentile(column, F.lit(0.99)).alias("high"))
    low = F.greatest(F.coalesce("low", F.lit(1.0)), F.lit(1e-8))
    return values.crossJoin(F.broadcast(q)).withColumn("scaled", F.log1p(F.least(F.greatest(F.col(column), F.lit(0.0)), F.coalesce("high", F.lit(1.0))) / low)).drop("low", "high")


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, change): sums of the absolute differences of two graphs' rows."""
    both = a.select("i", "j", "w").unionByName(b.select("i", "j", (-F.col("w")).alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))
    return both.groupBy("i").agg(F.sum(F.abs("w")).alias("change"))


def reference_embedding(features: DataFrame, spectral: DataFrame | None, mode: str = "hybrid", weight: float = 1.0) -> DataFrame:
    """(i, v): the features, the spectral embedding times its weight, or both side by side."""
    if mode == "representation" or spectral is None:
        return features.select("i", "v")
    scaled = spectral.select("i", F.transform("v", lambda x: x * F.lit(float(weight))).alias("s"))
    if mode == "spectral":
        return scaled.select("i", F.col("s").alias("v"))
    if mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    return features.join(scaled, "i").select("i", F.concat("v", "s").alias("v"))


def phase_weights(n: int, rising: bool = False) -> list[float]:
    """Ones, or numbers from a half to one."""
    return [0.5 + 0.5 * k / max(n - 1, 1) for k in range(n)] if rising else [1.0] * n


def wave_coverage(targets: DataFrame, proxies: DataFrame, tau: float = 1.0, least: float = 1e-8) -> DataFrame:
    """One row: minus the mean over targets(i, v) of the log of the mean closeness to the chosen few proxies(p, v)."""
    near = targets.select("i", F.col("v").alias("x")).crossJoin(F.broadcast(proxies.select(F.col("v").alias("y")))).groupBy("i").agg(F.avg(F.exp(-F.pow(distance(F.col("x"), F.col("y")), 2) / tau)).alias("c"))
    return near.agg((-F.avg(F.log(F.col("c") + least))).alias("wave_coverage"))
