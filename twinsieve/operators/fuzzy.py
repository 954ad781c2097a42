"""Fuzzy graphs of kNN lists: local scales, memberships, unions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.vectors import total


def lists(knn: DataFrame) -> DataFrame:
    """(i, d, n): the distances of each row, nearest first."""
    rows = knn.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "dist"))).alias("r"))
    return rows.select("i", F.transform("r", lambda x: x["dist"]).alias("d"), F.size("r").alias("n"))


def rho(d: Column, connectivity: float = 1.0) -> Column:
    """The distance at which a row counts as connected, between two neighbours where connectivity is no integer."""
    connectivity = max(connectivity, 0.0)
    whole = math.floor(connectivity)
    part = connectivity - whole
    last = F.size(d) - 1
    at = lambda k: F.get(d, F.least(F.lit(k), last))
    first = at(max(whole - 1, 0))
    after = at(1) if whole <= 0 else at(whole)
    return F.when(F.size(d) == 0, 0.0).otherwise(first + part * (after - first))


def sigma(d: Column, r: Column, target: float, steps: int = 64) -> Column:
    """The width at which the memberships of a row add up to the target: doubling, then halving."""

    def value(width: Column) -> Column:
        return total(F.transform(d, lambda x: F.exp(-F.greatest(F.lit(0.0), x - r) / width)))

    high = F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.lit(1.0), lambda h, _: F.when((h <= 1e6) & (value(h) < target), h * 2).otherwise(h))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * 0.5
        over = value(mid) > target
        return F.struct(F.when(over, s["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1e-6).alias("lo"), high.alias("hi")), halve)
    return F.when(F.size(d) == 0, 1.0).otherwise(F.greatest((found["lo"] + found["hi"]) * 0.5, F.lit(1e-6)))


def scales(knn: DataFrame, k: int, connectivity: float = 1.0, target: float | None = None, steps: int = 64) -> DataFrame:
    """(i, rho, sigma) of each row; the target is log2(k + 1) unless given."""
    near = lists(knn).withColumn("rho", rho(F.col("d"), connectivity))
    return near.select("i", "rho", sigma(F.col("d"), F.col("rho"), math.log2(k + 1) if target is None else target, steps).alias("sigma"))


def directed(knn: DataFrame, scale: DataFrame) -> DataFrame:
    """(i, j, w): membership of each neighbour."""
    w = F.exp(-F.greatest(F.lit(0.0), F.col("dist") - F.col("rho")) / F.col("sigma"))
    return knn.join(scale, "i").select("i", "j", F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)).alias("w")).where("w <> 0")


def union(edges: DataFrame) -> DataFrame:
    """A + A' - A * A': an edge if it holds in either direction."""
    # an edge is dealt out once, under the lesser end, and turned after the sum
    forth, back = F.when(F.col("i") <= F.col("j"), F.col("w")), F.when(F.col("i") >= F.col("j"), F.col("w"))
    rows = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.coalesce(forth, F.lit(0.0)).alias("a"), F.coalesce(back, F.lit(0.0)).alias("b"))
    sums = rows.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = sums.select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w")).where("w <> 0")
    ends = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    both = F.when(F.col("i") == F.col("j"), F.array(ends("i", "j"))).otherwise(F.array(ends("i", "j"), ends("j", "i")))
    return sums.select(F.explode(both).alias("e"), "w").select("e.i", "e.j", "w")


def union_of_symmetric(edges: DataFrame) -> DataFrame:
    """The union of a graph that has every edge in both directions, of one weight: no edge need meet its reverse."""
    return edges.select("i", "j", (F.col("w") + F.col("w") - F.col("w") * F.col("w")).alias("w")).where("w <> 0")


def merge(graphs: list[DataFrame], mode: str = "mean") -> DataFrame:
    """One graph of several: the larger weight (max), the mean over all graphs, or the probability of any (union)."""
    if not graphs:
        raise ValueError("no graph to merge")
    rows = graphs[0]
    for g in graphs[1:]:
        rows = rows.unionByName(g)
    if mode == "max":
        w = F.max("w")
    elif mode == "mean":
        w = F.sum("w") / len(graphs)
    elif mode == "union":
        w = 1 - F.product(1 - F.col("w"))
    else:
        raise ValueError(f"unknown merge: {mode}")
    return rows.groupBy("i", "j").agg(w.alias("w")).where("w <> 0")


def local_graph(knn: DataFrame, k: int, **options) -> DataFrame:
    """The symmetric graph of one neighbourhood size."""
    near = knn.where(F.col("rank") <= k)
    return union(directed(near, scales(near, k, **options)))


def listed_graph(lists: DataFrame, k: int, connectivity: float = 1.0, target: float | None = None, steps: int = 64) -> DataFrame:
    """local_graph of lists (i, j, dist), nearest first: the scales are found beside the list that they are of."""
    near = lists.where(F.size("j") > 0).select("i", F.slice("j", 1, k).alias("j"), F.slice("dist", 1, k).alias("d"))
    near = near.withColumn("rho", rho(F.col("d"), connectivity))
    near = near.withColumn("sigma", sigma(F.col("d"), F.col("rho"), math.log2(k + 1) if target is None else target, steps))
    rows = near.select("i", "rho", "sigma", F.explode(F.arrays_zip("j", "d")).alias("e"))
    w = F.exp(-F.greatest(F.lit(0.0), F.col("e.d") - F.col("rho")) / F.col("sigma"))
    return union(rows.select("i", F.col("e.j").alias("j"), F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)).alias("w")).where("w <> 0"))


def multi_scale(knn: DataFrame, ks: list[int], mode: str = "mean", **options) -> DataFrame:
    """The merged graph of several sizes, from one list of the largest; the merge is made symmetric once more."""
    return union(merge([local_graph(knn, k, **options) for k in sorted(set(ks))], mode))


def reference_distances(knn: DataFrame) -> DataFrame:
    """D + D' of the kNN distances (the smaller and the larger of both directions, absent as 0)."""
    both = knn.select("i", "j", "dist").unionByName(knn.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return both.groupBy("i", "j").agg(F.sum("dist").alias("dist")).where("dist <> 0")
