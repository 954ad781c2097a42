"""Confidence of nodes and edges, and correction of one modality's graph by the other's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import EPS
from twinsieve.operators import graph as G
from twinsieve.operators.fuzzy import union


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def healthy(image: dict, text: dict, prefer: str | None = None) -> str:
    """The modality with the lower collapse score, then the higher entropy, then image."""
    if prefer is not None:
        if prefer.lower() not in ("image", "text"):
            raise ValueError(f"no such modality: {prefer}")
        return prefer.lower()
    if image["collapse_score"] != text["collapse_score"]:
        return "image" if image["collapse_score"] < text["collapse_score"] else "text"
    return "image" if image["spectral_entropy"] >= text["spectral_entropy"] else "text"


def global_confidences(image: float, text: float, tau: float = 0.5) -> tuple[float, float]:
    """Shares of the two modalities: softmax of the negative collapse scores."""
    a, b = -image / max(tau, EPS), -text / max(tau, EPS)
    top = max(a, b)
    x, y = math.exp(a - top), math.exp(b - top)
    return x / (x + y), y / (x + y)


def raw_entropy(edges: DataFrame, nodes: DataFrame, eps: float = EPS) -> DataFrame:
    """(i, entropy): of the weights as they are, over the log of their number; 0 up to one edge."""
    p = F.greatest(F.col("w"), F.lit(eps))
    h = -F.sum(p * F.log(p + eps)) / F.greatest(F.log(F.count("*") + eps), F.lit(eps))
    out = edges.groupBy("i").agg(F.when(F.count("*") > 1, unit(h)).otherwise(0.0).alias("entropy"))
    return nodes.select("i").join(out, "i", "left").select("i", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def entropy_kappa(h: Column, tau: float = 0.25, least: float = 0.05) -> Column:
    return F.least(F.greatest(least + (1 - least) * F.exp(-(1 - h) / max(tau, EPS)), F.lit(least)), F.lit(1.0))


def diffusion_stability(p: DataFrame, nodes: DataFrame, hops: int = 2, eps: float = EPS) -> DataFrame:
    """(i, score): cosine of each row of P and of its power."""
    far = p
    for _ in range(hops - 1):
        far = G.matmul(far, p)
    both = G.aligned(a=p, b=far)
    a, b = F.sqrt(F.sum(F.col("a") ** 2)), F.sqrt(F.sum(F.col("b") ** 2))
    out = both.groupBy("i").agg(F.when((a > eps) & (b > eps), unit(F.sum(F.col("a") * F.col("b")) / F.greatest(a * b, F.lit(eps)))).otherwise(0.0).alias("score"))
    return nodes.select("i").join(out, "i", "left").select("i", F.coalesce("score", F.lit(0.0)).alias("score"))


def node_confidence(p: DataFrame, nodes: DataFrame, other: DataFrame | None = None, mode: str = "entropy", tau: float = 0.25, least: float = 0.05, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 15, hops: int = 2) -> DataFrame | None:
    """(i, kappa): trust in each node from the entropy of its row, or from entropy, agreement and stability together."""
    if mode == "none":
        return None
    entropy = raw_entropy(p, nodes)
    if mode == "entropy":
        return entropy.select("i", entropy_kappa(F.col("entropy"), tau, least).alias("kappa"))
    if mode != "multi_view":
        raise ValueError(f"unknown mode: {mode}")
    if other is None:
        raise ValueError("multi_view needs the other modality's graph")
    views = entropy.join(G.neighbour_jaccard(p, other, nodes, k).withColumnRenamed("score", "agreement"), "i").join(diffusion_stability(p, nodes, hops).withColumnRenamed("score", "stability"), "i")
    e, a, d = weights
    both = unit((e * F.col("entropy") + a * F.col("agreement") + d * F.col("stability")) / max(e + a + d, EPS))
    return views.select("i", F.least(F.greatest(least + (1 - least) * both, F.lit(least)), F.lit(1.0)).alias("kappa"))


def edge_scaled(edges: DataFrame, by: float, kappa: DataFrame | None) -> DataFrame:
    """w * by * sqrt(kappa_i kappa_j)."""
    if kappa is None:
        return G.scaled(edges, by)
    out = edges.join(kappa.withColumnRenamed("kappa", "_a"), "i").join(kappa.select(F.col("i").alias("j"), F.col("kappa").alias("_b")), "j")
    return G.present(out.select("i", "j", (F.col("w") * by * F.sqrt(F.col("_a") * F.col("_b"))).alias("w")))


def redundancy(edges: DataFrame, nodes: DataFrame, k: int = 15, eps: float = EPS) -> DataFrame:
    """(i, redundancy): how alike the rows of a node and of its neighbours are, over the node's neighbourhood."""
    near = G.top_neighbours(edges, k).select("i", "j", "w")
    size = near.groupBy("i").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("w") ** 2)).alias("base"))
    inner = near.select("i", F.col("j").alias("m")).join(edges.select(F.col("i").alias("m"), F.col("j").alias("c"), F.col("w").alias("v")), "m").join(near.select("i", F.col("j").alias("c"), "w"), ["i", "c"])
    each = inner.groupBy("i", "m").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.sqrt(F.sum(F.col("v") ** 2)).alias("own"))
    cos = each.join(size, "i").select("i", "n", "base", F.when((F.col("own") > eps) & (F.col("base") > eps), unit(F.col("dot") / F.greatest(F.col("base") * F.col("own"), F.lit(eps)))).otherwise(0.0).alias("cos"))
    out = cos.groupBy("i").agg(F.when(F.first("n") > 1, unit(F.sum("cos") / F.first("n"))).otherwise(0.0).alias("redundancy"))
    return nodes.select("i").join(out, "i", "left").select("i", F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"))


def separability(edges: DataFrame, nodes: DataFrame, k: int = 15, eps: float = EPS) -> DataFrame:
    """(i, separability): entropy of the k heaviest weights as shares: 1 if none stands out."""
    near = G.top_neighbours(edges, k).withColumn("s", F.sum("w").over(Window.partitionBy("i")))
    near = near.withColumn("p", F.greatest(F.col("w") / F.greatest("s", F.lit(eps)), F.lit(eps)))
    near = near.withColumn("p", F.col("p") / F.greatest(F.sum("p").over(Window.partitionBy("i")), F.lit(eps)))
    h = -F.sum(F.col("p") * F.log(F.col("p") + eps)) / F.greatest(F.log(F.count("*") + eps), F.lit(eps))
    out = near.groupBy("i").agg(F.when((F.count("*") > 1) & (F.first("s") > eps), unit(h)).otherwise(0.0).alias("separability"))
    return nodes.select("i").join(out, "i", "left").select("i", F.coalesce("separability", F.lit(0.0)).alias("separability"))


def local_collapse(edges: DataFrame, nodes: DataFrame, k: int = 15, alpha: float = 0.5) -> DataFrame:
    """(i, collapse): redundancy and lost separability, mixed."""
    alpha = min(max(alpha, 0.0), 1.0)
    both = redundancy(edges, nodes, k).join(separability(edges, nodes, k), "i")
    return both.select("i", unit(alpha * F.col("redundancy") + (1 - alpha) * F.col("separability")).alias("collapse"))


def edge_confidence(keys: DataFrame, collapse: DataFrame, tau: float = 4.0, name: str = "q") -> DataFrame:
    """(i, j, q): exp(-tau * mean collapse of both ends)."""
    out = keys.join(collapse.withColumnRenamed("collapse", "_a"), "i").join(collapse.select(F.col("i").alias("j"), F.col("collapse").alias("_b")), "j")
    return out.select("i", "j", unit(F.exp(-max(tau, EPS) * 0.5 * (F.col("_a") + F.col("_b")))).alias(name))


def collapse_weights(image: DataFrame, text: DataFrame, nodes: DataFrame, k: int = 15, alpha: float = 0.5, tau: float = 4.0, lam: float = 0.3, eps: float = EPS) -> DataFrame:
    """(i, j, image, text, t2i, i2t): how far the weaker side of each edge moves towards the stronger."""
    both = G.aligned(image=image, text=text)
    q = edge_confidence(both.select("i", "j"), local_collapse(image, nodes, k, alpha), tau, "qi").join(edge_confidence(both.select("i", "j"), local_collapse(text, nodes, k, alpha), tau, "qt"), ["i", "j"])
    qi, qt = F.col("qi"), F.col("qt")
    lam = min(max(lam, 0.0), 1.0)
    t2i = F.when(qt >= qi, unit(lam * F.greatest(1 - qi / (qt + eps), F.lit(0.0)))).otherwise(0.0)
    i2t = F.when(qi > qt, unit(lam * F.greatest(1 - qt / (qi + eps), F.lit(0.0)))).otherwise(0.0)
    return both.join(q, ["i", "j"]).select("i", "j", "image", "text", t2i.alias("t2i"), i2t.alias("i2t"))


def gate(source: Column, target: Column, high: float = 0.6, low: float = 0.3, gap: float = 0.15) -> Column:
    return ((source > high) & (target < low) & (source - target > gap)).cast("double")


def confidence_weights(image: DataFrame, text: DataFrame, shares: tuple[float, float], kappas: tuple[DataFrame | None, DataFrame | None] = (None, None), gated: bool = True, eps: float = EPS) -> DataFrame:
    """(i, j, image, text, t2i, i2t) from C = share * P * sqrt(kappa_i kappa_j) of either side, with the hard gate or without."""
    if kappas[0] is None and kappas[1] is None:
        both = G.aligned_shares(image, text, shares).withColumnsRenamed({"a": "image", "b": "text", "pa": "ci", "pb": "ct"})
    else:
        ci, ct = (edge_scaled(G.stochastic(g), s, k) for g, s, k in zip((image, text), shares, kappas, strict=True))
        both = G.aligned(image=image, text=text, ci=ci, ct=ct)
    a, b = F.col("ci"), F.col("ct")
    up, down = F.greatest(b - a * b, F.lit(0.0)), F.greatest(a - a * b, F.lit(0.0))
    t2i, i2t = up / (up + eps), down / (down + eps)
    if gated:
        t2i, i2t = gate(b, a) * t2i, gate(a, b) * i2t
    return both.select("i", "j", "image", "text", t2i.alias("t2i"), i2t.alias("i2t"))


def guided(weights: DataFrame, image: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both graphs after each edge's weaker side moved; of edges new to the image graph each row keeps k."""
    toward = lambda a, b, w: F.greatest((1 - F.col(w)) * F.col(a) + F.col(w) * F.col(b), F.lit(0.0))
    new_image = G.present(weights.select("i", "j", toward("image", "text", "t2i").alias("w")))
    new_text = G.present(weights.select("i", "j", toward("text", "image", "i2t").alias("w")))
    return union(G.added_limited(image, new_image, k)), union(new_text)


def bidirectional(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G + alpha (H - G), made symmetric, for both."""
    move = lambda a, b, w: G.present(weights.select("i", "j", (F.col(a) + F.col(w) * (F.col(b) - F.col(a))).alias("w")))
    return union(move("image", "text", "t2i")), union(move("text", "image", "i2t"))


def directional(collapsed: DataFrame, sound: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The collapsed graph times a power of the sound one's transition, made symmetric."""
    return union(G.intersection(collapsed, G.power(G.stochastic(sound), alpha)))
