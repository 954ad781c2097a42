"""Diffusion wavelets on graphs: P^s f - P^2s f."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.scores import EPS, shift_mix
from twinsieve.functions.vectors import l2, norm
from twinsieve.operators import graph as G
from twinsieve.session import settle


def scales_of(text: str | list[int]) -> list[int]:
    out = sorted({int(x) for x in (text.split(",") if isinstance(text, str) else text) if str(x).strip() and int(x) >= 1})
    if not out:
        raise ValueError("a positive scale is needed")
    return out


def powers(edges: DataFrame, signal: DataFrame, dim: int, most: int) -> list[DataFrame]:
    """signal(i, v) and its first `most` steps of the walk; every step is checkpointed so that plans stay short."""
    p = settle(G.stochastic(edges))
    out = [signal.select("i", F.transform("v", lambda x: x.cast("double")).alias("v"))]
    for _ in range(most):
        out.append(settle(G.apply(p, out[-1], dim)))
    return out


def signatures(edges: DataFrame, signal: DataFrame, dim: int, scales: list[int], normalise: bool = True, eps: float = EPS) -> dict[int, DataFrame]:
    """scale -> (i, v)."""
    step = powers(edges, signal, dim, 2 * max(scales))
    out = {}
    for s in scales:
        d = step[s].join(step[2 * s].withColumnRenamed("v", "u"), "i").select("i", F.zip_with("v", "u", lambda a, b: a - b).alias("v"))
        out[s] = d.select("i", l2(F.col("v"), eps).alias("v")) if normalise else d
    return out


def difference_graphs(reference: DataFrame, source: DataFrame, scales: list[int], k: int | None = None, threshold: float | None = None) -> dict[int, DataFrame]:
    """The same with a sparse matrix as the signal, pruned after each step."""
    p = G.stochastic(reference)
    step = [source.select("i", "j", "w")]
    for _ in range(2 * max(scales)):
        step.append(settle(G.sparsified(G.matmul(p, step[-1]), k, threshold)))
    return {s: G.present(G.aligned(a=step[s], b=step[2 * s]).select("i", "j", (F.col("a") - F.col("b")).alias("w"))) for s in scales}


def energy_entropy(response: DataFrame, eps: float = EPS) -> DataFrame:
    """One row: energies of the rows of a response, the entropy of their shares over that of equal ones, and 1 less that."""
    e = response.select(F.pow(norm(F.col("v")), 2).alias("e"))
    total = e.agg(F.count("*").alias("num_nodes"), F.sum("e").alias("total_scale_energy"), F.avg("e").alias("mean_scale_energy"), F.max("e").alias("max_scale_energy"))
    p = F.col("e") / F.greatest("total_scale_energy", F.lit(eps))
    h = e.crossJoin(F.broadcast(total)).agg(F.sum(-p * F.log(p + eps)).alias("h"))
    wide = total.crossJoin(F.broadcast(h))
    some = (F.col("num_nodes") > 1) & (F.col("total_scale_energy") > eps)
    entropy = F.when(some, F.least(F.greatest(F.col("h") / F.log("num_nodes"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    zero = lambda c: F.when(some, F.col(c)).otherwise(0.0).alias(c)
    return wide.select("num_nodes", zero("total_scale_energy"), zero("mean_scale_energy"), zero("max_scale_energy"), entropy.alias("normalized_scale_entropy"), (1 - entropy).alias("scale_collapse_score"))


def probes(nodes: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(i, v): repeatable pseudo-random probes in [-0.5, 0.5) / sqrt(dim), a function of node and place alone."""
    return nodes.select("i", F.array(*[((shift_mix(F.col("i") * dim + k, seed) / 2147483648.0) - 0.5) / (dim**0.5) for k in range(dim)]).alias("v"))
