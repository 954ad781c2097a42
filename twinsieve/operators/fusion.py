"""One graph of the two modalities'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.scores import EPS
from twinsieve.functions.vectors import dot, l2
from twinsieve.operators import graph as G
from twinsieve.operators import wavelet
from twinsieve.operators.correction import global_confidences, unit
from twinsieve.operators.fuzzy import union


def intersection(image: DataFrame, text: DataFrame) -> DataFrame:
    return union(G.intersection(image, text))


def average(image: DataFrame, text: DataFrame) -> DataFrame:
    both = G.present(G.aligned(a=image, b=text).select("i", "j", ((F.col("a") + F.col("b")) / 2).alias("w")))
    return G.clipped(G.averaged(both))


def average_reference(image: DataFrame, text: DataFrame) -> DataFrame:
    return union(G.present(G.aligned(a=image, b=text).select("i", "j", ((F.col("a") + F.col("b")) / 2).alias("w"))))


def union_reference(image: DataFrame, text: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return union(G.present(G.aligned(a=image, b=text).select("i", "j", (a + b - a * b).alias("w"))))


def confidence_aware(image: DataFrame, text: DataFrame, shares: tuple[float, float] = (0.5, 0.5), lam: float = 1.0, mu: float = 1.0, eps: float = EPS) -> DataFrame:
    """Edges by their confidence share * P, and a soft gate where both sides have some."""
    both = G.aligned_shares(image, text, shares).withColumnsRenamed({"pa": "ci", "pb": "ct"})
    x, y = (F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(lam)) for c in ("ci", "ct"))
    fused = x / (x + y + eps) * F.col("a") + y / (x + y + eps) * F.col("b")
    return union(G.present(both.select("i", "j", (F.pow(F.col("ci") * F.col("ct") + eps, F.lit(mu)) * fused).alias("w"))))


def autonomy(weights: DataFrame, eps: float = EPS) -> DataFrame:
    """Edges by how much either side kept of its own: weights(i, j, image, text, t2i, i2t)."""
    a, b = 1 - F.col("t2i"), 1 - F.col("i2t")
    w = a / (a + b + eps) * F.col("image") + b / (a + b + eps) * F.col("text")
    return union(G.present(weights.select("i", "j", w.alias("w"))))


def _mixed(share: float) -> Column:
    return F.zip_with("v", "u", lambda p, q: share * p + (1 - share) * q)


def wavelet_latent(image: DataFrame, text: DataFrame, probes: DataFrame, dim: int, scales: list[int], mode: str = "fixed_per_scale", temperature: float = 1.0, sparse: float = 0.01, sym: float = 1.0, k: int | None = 64, threshold: float = 0.0, eps: float = EPS) -> DataFrame:
    """Edges of either graph, weighed by how alike the mixed multi-scale responses of their ends are.

    probes(i, v) of length dim are diffused on both graphs; per scale the responses are
    mixed in equal shares, or by the entropy of their energies; an edge's weight is the
    mean positive cosine over the scales less `sparse`, made symmetric, cut to the k best
    of each row and made symmetric again.
    """
    a, b = (wavelet.signatures(g, probes, dim, scales, normalise=False) for g in (image, text))
    keys = G.aligned(a=image, b=text).select("i", "j")
    scored = None
    for s in scales:
        x, y = a[s], b[s]
        share = 0.5
        if mode == "collapse_aware":
            ca, cb = (wavelet.energy_entropy(r).first()["scale_collapse_score"] for r in (x, y))
            share = global_confidences(temperature * ca, temperature * cb, 1.0)[0]
        elif mode != "fixed_per_scale":
            raise ValueError(f"unknown weights: {mode}")
        mixed = x.join(y.withColumnRenamed("v", "u"), "i").select("i", l2(_mixed(share), eps).alias("v"))
        own = keys.join(mixed.withColumnRenamed("v", "_a"), "i").join(mixed.select(F.col("i").alias("j"), F.col("v").alias("_b")), "j").select("i", "j", unit(dot(F.col("_a"), F.col("_b"))).alias("s"))
        scored = own if scored is None else scored.unionByName(own)
    edges = scored.groupBy("i", "j").agg(F.avg("s").alias("s"))
    edges = G.present(edges.select("i", "j", F.greatest(F.col("s") - sparse, F.lit(0.0)).alias("w")))
    if sym > 0:
        blend = 1 / (1 + sym)
        both = G.aligned(a=edges, b=G.averaged(edges))
        edges = G.present(both.select("i", "j", (blend * F.col("a") + (1 - blend) * F.col("b")).alias("w")))
    edges = G.averaged(G.clipped(edges))
    return G.clipped(G.averaged(G.sparsified(edges, k, threshold, absolute=False)))
