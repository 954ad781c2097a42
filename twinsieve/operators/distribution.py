"""How well few points stand for many: losses between point sets, as aggregates.

points(i, v) may be large; proxies(p, v), frequencies(f, v) and directions are a chosen
few, so the pairs of a point and a proxy are as many as the points times a constant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import numbered
from twinsieve.functions.vectors import distance, dot, norm
from twinsieve.session import reachable, settle

#: Rows of a block of either side of a sum over pairs.
BLOCK = 4096


def ecf(points: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(f, re, im): means of the cosines and sines of x . omega."""
    t = dot(F.col("x"), F.col("v"))
    pairs = points.select(F.col("v").alias("x")).crossJoin(F.broadcast(frequencies)).select("f", t.alias("t"))
    return pairs.groupBy("f").agg(F.avg(F.cos("t")).alias("re"), F.avg(F.sin("t")).alias("im"))


def discrepancy(a: DataFrame, b: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(f, score): squared difference of two empirical characteristic functions."""
    both = ecf(a, frequencies).join(ecf(b, frequencies).select("f", F.col("re").alias("r"), F.col("im").alias("m")), "f")
    return both.select("f", (F.pow(F.col("re") - F.col("r"), 2) + F.pow(F.col("im") - F.col("m"), 2)).alias("score"))


def cfd(a: DataFrame, b: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: mean amplitude of the difference, over the frequencies."""
    return discrepancy(a, b, frequencies).agg(F.avg(F.sqrt("score")).alias("cfd"))


def phase_cfd(a: DataFrame, b: DataFrame, frequencies: DataFrame, weight: float = 0.5, least: float = 1e-3) -> DataFrame:
    """The amplitude term, and the phase term where both amplitudes reach the least."""
    both = ecf(a, frequencies).join(ecf(b, frequencies).select("f", F.col("re").alias("r"), F.col("im").alias("m")), "f")
    size = F.sqrt(F.pow(F.col("re") - F.col("r"), 2) + F.pow(F.col("im") - F.col("m"), 2))
    clear = (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) >= least) & (F.sqrt(F.col("r") ** 2 + F.col("m") ** 2) >= least)
    phase = F.when(clear, 1 - F.cos(F.atan2("im", "re") - F.atan2("m", "r"))).otherwise(0.0)
    return both.agg(F.avg(size + weight * phase).alias("pd_cfd"))


def scheduled(scores: DataFrame, frequencies: DataFrame, limit: float, k: int) -> DataFrame:
    """The k frequencies of the largest discrepancy among those no longer than the limit."""
    near = frequencies.where(norm(F.col("v")) <= limit).select("f")
    return scores.join(near, "f").orderBy(F.desc("score"), "f").limit(k)


def kernel_mean(x: DataFrame, y: DataFrame, width: float, rows: int = BLOCK) -> DataFrame:
    """One row: the mean of a Gaussian kernel over all pairs of a row of x(v) and a row of y(v).

    Rows are dealt into blocks of about `rows`; a task holds one block of either side and
    sums its kernel matrix, so memory does not follow the input and one number a pair of
    blocks is shuffled.
    """

    def blocks(df: DataFrame, n: int) -> int:
        return max(1, -(-n // rows))

    nx, ny = x.count(), y.count()
    bx, by = blocks(x, nx), blocks(y, ny)
    left = x.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("v"), F.lit(bx)).alias("bx"), "v").withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(by - 1))))
    right = y.select(F.lit(1).alias("side"), F.pmod(F.xxhash64("v"), F.lit(by)).alias("by"), "v").withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(bx - 1))))
    names = ["side", "bx", "by", "v"]
    both = left.select("side", F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), "v").unionByName(right.select("side", F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), "v")).select(*names)

    def total(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(part.to_numpy()) if len(part) else None for part in (group.v[group.side == 0], group.v[group.side == 1]))
        out = 0.0
        if a is not None and b is not None:
            norms = (b * b).sum(axis=1)
            for k in range(0, len(a), 512):
                part = a[k : k + 512]
                square = (part * part).sum(axis=1)[:, None] + norms[None, :] - 2 * part @ b.T
                out += float(np.exp(-np.maximum(square, 0) / (2 * width * width)).sum())
        return pd.DataFrame({"s": [out]})

    return both.groupBy("bx", "by").applyInPandas(total, "s double").agg((F.sum("s") / F.lit(float(max(nx * ny, 1)))).alias("mean"))


def mmd2(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """One row: biased squared maximum mean discrepancy with a Gaussian kernel, over all rows of both sides.

    The work is the product of the rows, in blocks; no row is left out.
    """
    reachable(a.sparkSession)
    aa, bb, ab = (kernel_mean(x, y, width).select(F.col("mean").alias(n)) for x, y, n in ((a, a, "aa"), (b, b, "bb"), (a, b, "ab")))
    return aa.crossJoin(bb).crossJoin(ab).select((F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("mmd2"))


def median_width(points: DataFrame) -> DataFrame:
    """One row: sqrt(half the lower median of the positive squared distances) of a sample."""
    x = points.select(F.col("i").alias("a"), F.col("v").alias("x"))
    d = x.crossJoin(points.select(F.col("i").alias("b"), F.col("v").alias("y"))).where("a < b").select(F.pow(distance(F.col("x"), F.col("y")), 2).alias("d")).where("d > 0")
    return d.agg(F.sqrt(F.expr("percentile_disc(0.5) within group (order by d)") / 2).alias("width"))


def quantiles(values: DataFrame, parts: int) -> DataFrame:
    """(q, x): values(x) sorted and read at (q + 0.5) / parts, between neighbours."""
    n = values.count()
    order = numbered(values, [F.col("x")], "k").select("k", "x")
    at = values.sparkSession.range(parts).select(F.col("id").alias("q"), F.greatest(F.least((F.col("id") + 0.5) / parts * n - 0.5, F.lit(n - 1.0)), F.lit(0.0)).alias("t"))
    at = at.withColumn("lo", F.floor("t")).withColumn("hi", F.least(F.col("lo") + 1, F.lit(n - 1)))
    low = at.join(order.withColumnRenamed("x", "a"), F.col("lo") == F.col("k")).drop("k")
    return low.join(order.withColumnRenamed("x", "b"), F.col("hi") == F.col("k")).select("q", (F.col("a") + (F.col("t") - F.col("lo")) * (F.col("b") - F.col("a"))).alias("x"))


def sliced_wasserstein(a: DataFrame, b: DataFrame, directions: list[list[float]], parts: int) -> float:
    """Mean over directions of the mean absolute difference of quantiles."""
    total = 0.0
    for d in directions:
        line = F.array(*[F.lit(float(x)) for x in d])
        x, y = (quantiles(t.select(dot(F.col("v"), line).alias("x")), parts) for t in (a, b))
        total += x.join(y.withColumnRenamed("x", "y"), "q").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("d")).first()["d"]
    return total / max(len(directions), 1)


def coverage(points: DataFrame, proxies: DataFrame, tau: float, mean: bool = False) -> DataFrame:
    """(i, cover): exp(-squared distance / tau) to the proxies, summed or averaged."""
    pairs = points.crossJoin(F.broadcast(proxies.select(F.col("v").alias("y"))))
    size = F.exp(-F.pow(distance(F.col("v"), F.col("y")), 2) / tau)
    return pairs.groupBy("i").agg((F.avg(size) if mean else F.sum(size)).alias("cover"))


def nearest_loss(points: DataFrame, proxies: DataFrame) -> DataFrame:
    """One row: mean over the proxies of the squared distance to the nearest point."""
    pairs = points.select(F.col("v").alias("x")).crossJoin(F.broadcast(proxies))
    return pairs.groupBy("p").agg(F.min(F.pow(distance(F.col("x"), F.col("v")), 2)).alias("d")).agg(F.avg("d").alias("nearest_loss"))


def relation_losses(points: DataFrame, edges: DataFrame, proxies: DataFrame, tau: float, eps: float = 1e-8) -> DataFrame:
    """One row: -mean ln coverage, the same one step along the edges, and the edge-weighted gap of neighbours' coverage."""
    c = settle(coverage(points, proxies, tau))
    near = edges.join(c.select(F.col("i").alias("j"), F.col("cover").alias("cj")), "j")
    ahead = near.groupBy("i").agg(F.sum(F.col("w") * F.col("cj")).alias("a"))
    direct = c.agg((-F.avg(F.log(F.col("cover") + eps))).alias("coverage_loss"))
    step = c.join(ahead, "i", "left").agg((-F.avg(F.log(F.coalesce("a", F.lit(0.0)) + eps))).alias("propagated_loss"))
    gap = near.join(c, "i").agg((F.sum(F.col("w") * F.pow(F.col("cover") - F.col("cj"), 2)) / F.greatest(F.sum("w"), F.lit(eps))).alias("relation_loss"))
    return direct.crossJoin(step).crossJoin(gap)


def interpolated(queries: DataFrame, knn: DataFrame, values: DataFrame, tau: float, size: int) -> DataFrame:
    """(i, v): values(j, v) of each query's neighbours, weighed by the softmax of -squared distance / tau."""
    near = knn.withColumn("z", -F.col("dist") * F.col("dist") / tau)
    near = near.withColumn("e", F.exp(F.col("z") - F.max("z").over(Window.partitionBy("i"))))
    near = near.withColumn("e", F.col("e") / F.sum("e").over(Window.partitionBy("i")))
    sums = [F.sum(F.col("e") * F.get("v", F.lit(k))).alias(f"c{k}") for k in range(size)]
    return near.join(values.select(F.col("i").alias("j"), "v"), "j").groupBy("i").agg(*sums).select("i", F.array(*[f"c{k}" for k in range(size)]).alias("v"))
