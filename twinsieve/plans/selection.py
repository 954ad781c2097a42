"""The main plan: features, graphs, correction, fusion, embedding, proxies, matched samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.scores import subset_size
from twinsieve.operators import correction, fuzzy, kernels, matching, spectral, wavelet
from twinsieve.operators import graph as G
from twinsieve.operators.fusion import confidence_aware, wavelet_latent
from twinsieve.operators.knn import nearest
from twinsieve.session import settle


def modality_graph(features: DataFrame, k: int = 15) -> DataFrame:
    """The fuzzy graph of the k nearest, made symmetric twice."""
    return fuzzy.union_of_symmetric(fuzzy.listed_graph(settle(nearest(features, k)), k))


def unified(image: DataFrame, text: DataFrame, nodes: DataFrame, mode: str = "wavelet_latent", scales: list[int] | None = None, probe_dim: int = 8) -> DataFrame:
    """Guided alignment by local collapse, then the fusion asked for."""
    weights = settle(correction.collapse_weights(image, text, nodes))
    a, b = (settle(g) for g in correction.guided(weights, image))
    if mode == "graph":
        return confidence_aware(a, b)
    return wavelet_latent(a, b, wavelet.probes(nodes, probe_dim), probe_dim, scales or [1, 2])


def choose(pairs: DataFrame, ratio: float | None = None, budget: int | None = None, k: int = 15, embed: int = 16, candidates: int = 16, steps: int = 100, mode: str = "graph") -> DataFrame:
    """pairs(i, img, txt) -> (p, i, cost): a subset of the size asked for, one sample for each optimised proxy.

    The proxies, as many as the subset has samples, are a dense problem on the driver.
    """
    spark = pairs.sparkSession
    nodes = pairs.select("i")
    n = nodes.count()
    size = subset_size(n, ratio, budget)
    image, text = (settle(modality_graph(pairs.select("i", F.col(c).alias("v")), k)) for c in ("img", "txt"))
    fused = settle(unified(image, text, nodes, mode))
    values, rows = spectral.spectrum(fused, nodes, min(embed + 1, n), "walk")
    features = settle(spectral.embedded(rows, values, embed))
    chosen = [int(x) for x in np.sort(np.random.default_rng(0).choice(n, size, replace=False))]
    chosen = F.broadcast(spark.createDataFrame([(x,) for x in chosen], "at long"))
    start = np.array([r["v"] for r in features.join(chosen, "at").orderBy("at").collect()])
    proxies, _ = kernels.optimise(lambda fn: spectral.column_means(features, fn), start, steps)
    table = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in enumerate(proxies)], "p long, v array<double>")
    features = features.select("i", "v")
    near = matching.candidates(table, features, min(max(candidates, 2), n))
    cost = matching.costs(near, table, features, G.graph_score(fused, nodes))
    return matching.match(cost)
