"""From proxies to samples: candidates, costs and a one-to-one choice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.vectors import distance
from twinsieve.operators.kernels import LIMIT, assign
from twinsieve.operators.knn import knn

MISSING = 1e9


def candidates(proxies: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """(p, rank, i, dist): the k samples nearest to each proxy(p, v)."""
    near = knn(proxies.select(F.col("p").alias("i"), "v"), k, "l2", base=features, with_self=True)
    return near.select(F.col("i").alias("p"), "rank", F.col("j").alias("i"), "dist")


def costs(near: DataFrame, proxies: DataFrame, features: DataFrame, topology: DataFrame | None = None, waves: tuple[DataFrame, DataFrame] | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 0.1)) -> DataFrame:
    """(p, i, diff, wavelet, topo, cost): weighed squared distances of place and of wavelet signature, and the node's topology cost."""
    a, b, g = weights
    out = near.select("p", "i").join(proxies.select("p", F.col("v").alias("y")), "p").join(features.select("i", F.col("v").alias("x")), "i").select("p", "i", F.pow(distance(F.col("x"), F.col("y")), 2).alias("diff"))
    if waves:
        out = out.join(waves[0].select("p", F.col("v").alias("y")), "p").join(waves[1].select("i", F.col("v").alias("x")), "i").withColumn("wavelet", F.pow(distance(F.col("x"), F.col("y")), 2)).drop("x", "y")
    else:
        out = out.withColumn("wavelet", F.lit(0.0))
    out = out.join(topology.select("i", F.col("cost").alias("topo")), "i", "left").withColumn("topo", F.coalesce("topo", F.lit(0.0))) if topology is not None else out.withColumn("topo", F.lit(0.0))
    return out.select("p", "i", "diff", "wavelet", "topo", (a * F.col("diff") + b * F.col("wavelet") + g * F.col("topo")).alias("cost"))


def match(cost: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(p, i, cost): every proxy its own sample, at the least total cost among the candidates.

    The candidate table, at most `limit` proxies times their k, is a dense problem on the
    driver; a pair that is no candidate costs MISSING.
    """
    rows = cost.select("p", "i", "cost").limit(limit * 256 + 1).collect()
    ps, ids = sorted({r["p"] for r in rows}), sorted({r["i"] for r in rows})
    if len(ps) > limit or len(rows) > limit * 256:
        raise ValueError(f"more than {limit} proxies")
    if len(ids) < len(ps):
        raise ValueError("fewer candidates than proxies: take more neighbours")
    at_p, at_i = {p: k for k, p in enumerate(ps)}, {i: k for k, i in enumerate(ids)}
    dense = np.full((len(ps), len(ids)), MISSING)
    for r in rows:
        dense[at_p[r["p"]], at_i[r["i"]]] = r["cost"]
    got = assign(dense) if len(ps) else []
    return cost.sparkSession.createDataFrame([(p, ids[c], float(dense[k, c])) for k, (p, c) in enumerate(zip(ps, got, strict=True))], "p long, i long, cost double")


def first_unused(near: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(p, i): proxies in order take their nearest candidate that none before took; at most `limit` proxies times 256 candidates, more are refused."""
    rows = near.orderBy("p", "rank").limit(limit * 256 + 1).collect()
    if len(rows) > limit * 256:
        raise ValueError(f"more than {limit * 256} candidates")
    used: set[int] = set()
    out: dict[int, int] = {}
    for r in rows:
        if r["p"] not in out and r["i"] not in used:
            out[r["p"]] = r["i"]
            used.add(r["i"])
    return near.sparkSession.createDataFrame(sorted(out.items()), "p long, i long")


def match_loss(matched: DataFrame, proxies: DataFrame, features: DataFrame) -> DataFrame:
    """One row: mean squared distance of proxies and their samples."""
    both = matched.join(proxies.select("p", F.col("v").alias("y")), "p").join(features.select("i", F.col("v").alias("x")), "i")
    return both.agg(F.avg(F.pow(distance(F.col("x"), F.col("y")), 2)).alias("match_loss"))
