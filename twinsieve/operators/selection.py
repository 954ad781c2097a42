"""Selectors: a score for every sample, or a greedy choice one at a time.

A selector is a function of pairs(i, img, txt) and k that returns (i, rank, score); all
are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import fuse, normalise, shift_mix, top, with_totals
from twinsieve.functions.vectors import distance, joint, l2
from twinsieve.operators.knn import knn, nearest
from twinsieve.session import settle

METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(*names: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in names:
            if n.lower() in METHODS:
                raise ValueError(f"{n} is there already")
            METHODS[n.lower()] = f
        return f

    return add


def select(name: str, pairs: DataFrame, k: int, **options) -> DataFrame:
    if name.lower() not in METHODS:
        raise KeyError(f"unknown method: {name}; there are {sorted(METHODS)}")
    return METHODS[name.lower()](pairs, k, **options)


def view(pairs: DataFrame, which: str) -> DataFrame:
    """(i, v) of one modality, or of both side by side."""
    return pairs.select("i", (joint(F.col("img"), F.col("txt")) if which == "joint" else F.col(which)).alias("v"))


def neighbours(features: DataFrame, k: int) -> DataFrame:
    """Cosine neighbours, the row itself among them."""
    return knn(features, k, "cosine", with_self=True)


def _describe(temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            t = t.filter(pc.greater(pc.list_value_length(t["j"]), 0)).combine_chunks()
            if not t.num_rows:
                continue
            size = pc.list_value_length(t["j"]).to_numpy().astype(np.int64)
            d = t["dist"].combine_chunks().flatten().to_numpy()
            first = np.cumsum(size) - size
            z = (1 - d) / temperature
            e = np.exp(z - np.repeat(np.maximum.reduceat(z, first), size))
            p = e / np.repeat(np.maximum(np.add.reduceat(e, first), 1e-8), size)
            entropy = -np.add.reduceat(p * np.log(np.maximum(p, 1e-8)), first)
            others = np.add.reduceat(np.where(np.arange(len(d)) == np.repeat(first, size), 0.0, d), first)
            diversity = np.where(size > 1, others / np.maximum(size - 1, 1), d[first])
            yield pa.RecordBatch.from_arrays([t["i"].combine_chunks(), pa.array(entropy), pa.array(diversity), t["j"].combine_chunks()], names=["i", "entropy", "diversity", "j"])

    return run


def described(features: DataFrame, k: int, temperature: float = 0.07) -> DataFrame:
    """(i, entropy, diversity, j) of each row's cosine neighbours, the row itself among them.

    The entropy is that of the softmax of the similarities, the diversity the mean distance
    to the neighbours but the first. Both are taken where the list is found, so that only
    a row a query is kept or dealt out; every use of the result searches again.
    """
    return nearest(features, k, "cosine", with_self=True).mapInArrow(_describe(temperature), "i long, entropy double, diversity double, j array<long>")


def diversity_of(near: DataFrame) -> DataFrame:
    """(i, diversity): mean distance to the neighbours but the first."""
    return near.groupBy("i").agg(F.coalesce(F.avg(F.when(F.col("rank") > 1, F.col("dist"))), F.min("dist")).alias("diversity"))


def _shared(a: str, b: str, k: int) -> Column:
    """Neighbours in both lists over k."""
    return F.size(F.array_intersect(a, b)) / k


@method("entropy")
def entropy(pairs: DataFrame, k: int, near: int = 64, temperature: float = 0.07, **fusion) -> DataFrame:
    s = None
    for which in ("img", "txt", "joint"):
        own = described(view(pairs, which), near, temperature).select("i", F.col("entropy").alias(f"score_{which}"))
        s = own if s is None else s.join(own, "i")
    return _best(fuse(settle(s), **fusion), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    return top(scored, "score_pair", k).select("i", "rank", F.col("score_pair").alias("score"))


@method("presel")
def presel(pairs: DataFrame, k: int, near: int = 32, temperature: float = 0.07) -> DataFrame:
    return _best(described(view(pairs, "img"), near, temperature).withColumn("score_pair", 0.7 * F.col("entropy") + 0.3 * F.col("diversity")), k)


@method("visa")
def visa(pairs: DataFrame, k: int, near: int = 32, temperature: float = 0.07) -> DataFrame:
    t = described(view(pairs, "txt"), near, temperature).select("i", F.col("j").alias("j_txt"))
    s = described(view(pairs, "img"), near, temperature).join(t, "i").withColumn("overlap", _shared("j", "j_txt", near))
    return _best(s.withColumn("score_pair", 0.8 * (0.6 * F.col("entropy") + 0.4 * F.col("diversity")) + 0.2 * F.col("overlap")), k)


@method("dataprophet")
def dataprophet(pairs: DataFrame, k: int, near: int = 32, temperature: float = 0.07) -> DataFrame:
    s = None
    for w in ("img", "txt", "joint"):
        own = described(view(pairs, w), near, temperature).select("i", F.col("entropy").alias(f"e_{w}"), "diversity" if w == "joint" else F.col("j").alias(f"j_{w}"))
        s = own if s is None else s.join(own, "i")
    perplexity = 0.4 * F.col("e_img") + 0.4 * F.col("e_txt") + 0.2 * F.col("e_joint")
    return _best(s.withColumn("score_pair", 0.45 * perplexity + 0.30 * _shared("j_img", "j_txt", near) + 0.25 * F.col("diversity")), k)


@method("rand", "ccs-rand")
def rand(pairs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return top(pairs.select("i", shift_mix(F.col("i"), seed).alias("score")), "score", k, largest=False).select("i", "rank", F.col("score").cast("double").alias("score"))


@method("kcenter", "k-center", "ccs-kcenter")
def kcenter(pairs: DataFrame, k: int, first: int | None = None) -> DataFrame:
    """Farthest first on the joint view: k rounds, each a distance to the last centre and a maximum. Ties by i."""
    spark = pairs.sparkSession
    v = settle(view(pairs, "joint").withColumn("d", F.lit(float("inf"))))
    at = v.agg(F.min("i")).first()[0] if first is None else first
    out = []
    for r in range(1, k + 1):
        c = v.where(F.col("i") == at).first()
        out.append((c["i"], r, float(c["d"]) if r > 1 else 0.0))
        centre = F.array(*[F.lit(x) for x in c["v"]])
        v = v.withColumn("d", F.least("d", distance(F.col("v"), centre)))
        if r % 8 == 0:
            v = settle(v)
        if r < k:
            at = v.agg(F.max_by("i", F.struct("d", -F.col("i")))).first()[0]
    return spark.createDataFrame(out, "i long, rank int, score double")


@method("herd", "ccs-herd", "herding")
def herd(pairs: DataFrame, k: int) -> DataFrame:
    """The sample nearest to what brings the mean of the chosen back to the mean of all, k times. Ties by i."""
    spark = pairs.sparkSession
    v = settle(view(pairs, "joint"))
    size = len(v.first()["v"])
    mean = [x for x in v.agg(*[F.avg(F.get("v", F.lit(c))) for c in range(size)]).first()]
    run, out = [0.0] * size, []
    for r in range(1, k + 1):
        target = F.array(*[F.lit(r * m - s) for m, s in zip(mean, run, strict=True)])
        left = v.where(~F.col("i").isin([o[0] for o in out])) if out else v
        best = left.withColumn("d", distance(F.col("v"), target)).agg(F.min_by(F.struct("i", "v", "d"), F.struct("d", "i")).alias("b")).first()["b"]
        out.append((best["i"], r, float(best["d"])))
        run = [s + x for s, x in zip(run, best["v"], strict=True)]
    return spark.createDataFrame(out, "i long, rank int, score double")


def suppressed(scored: DataFrame, k: int, radius: float = 0.2) -> DataFrame:
    """scored(i, score, v): the best that is not within the cosine radius of one chosen, k times; then the best of the rest."""
    spark = scored.sparkSession
    left = settle(scored.select("i", "score", l2(F.col("v"), 1e-8).alias("v")).withColumn("out", F.lit(False)))
    out: list[tuple[int, int, float]] = []
    while len(out) < k:
        best = left.where("not out").agg(F.max_by(F.struct("i", "score", "v"), F.struct("score", -F.col("i"))).alias("b")).first()["b"]
        if best is None:
            break
        out.append((best["i"], len(out) + 1, float(best["score"])))
        c = F.array(*[F.lit(x) for x in best["v"]])
        sim = F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        left = left.withColumn("out", F.col("out") | (sim >= 1 - radius) | (F.col("i") == best["i"]))
        if len(out) % 8 == 0:
            left = settle(left)
    if len(out) < k:
        rest = left.where(~F.col("i").isin([o[0] for o in out])).orderBy(F.desc("score"), "i").limit(k - len(out)).collect()
        out += [(r["i"], len(out) + n, float(r["score"])) for n, r in enumerate(rest, 1)]
    return spark.createDataFrame(out, "i long, rank int, score double")


def clusters(features: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """(i, v, cluster, d) and the centres, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster", maxIter=30).fit(features.select(array_to_vector("v").alias("x")))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    spark = features.sparkSession
    table = spark.createDataFrame(list(enumerate(centres)), "cluster int, c array<double>")
    near = model.transform(features.withColumn("x", array_to_vector("v"))).join(F.broadcast(table), "cluster")
    return near.select("i", "v", "cluster", distance(F.col("v"), F.col("c")).alias("d")), centres


def nearest_of_clusters(pairs_view: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The member nearest to each centre; fewer clusters than k are filled up with the next nearest."""
    near, _ = clusters(pairs_view, k, seed)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("d", "i"))
    order = near.withColumn("first", (rank == 1)).withColumn("score", -F.col("d"))
    best = order.orderBy(F.desc("first"), F.desc("score"), "i").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("first"), F.desc("score"), "i"))).select("i", "rank", "score")


@method("dq")
def dq(pairs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return nearest_of_clusters(view(pairs, "joint"), k, seed)


def reduced(features: DataFrame, size: int, whiten: bool = False, eps: float = 1e-6) -> DataFrame:
    """(i, v) on the first principal axes; whitened: each over its deviation."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = features.withColumn("x", array_to_vector("v"))
    model = PCA(k=size, inputCol="x", outputCol="y").fit(x)
    y = model.transform(x).select("i", vector_to_array("y").alias("v"))
    stats = y.agg(*[F.avg(F.get("v", F.lit(c))).alias(f"m{c}") for c in range(size)], *[F.stddev(F.get("v", F.lit(c))).alias(f"s{c}") for c in range(size)]).first()
    parts = [(F.get("v", F.lit(c)) - stats[f"m{c}"]) / ((stats[f"s{c}"] + eps) if whiten else 1.0) for c in range(size)]
    return y.select("i", F.array(*parts).alias("v"))


@method("nms")
def near_memory(pairs: DataFrame, k: int, size: int = 8, seed: int = 0) -> DataFrame:
    return nearest_of_clusters(reduced(view(pairs, "joint"), size), k, seed)


@method("adap_sne", "adapsne")
def adap_sne(pairs: DataFrame, k: int, near: int = 16, seed: int = 0) -> DataFrame:
    """Sparse places of the first two principal axes (these stand in for a t-SNE map): the least dense member of each cluster."""
    plane = reduced(view(pairs, "joint"), 2)
    far = diversity_of(knn(plane, near, "l2", with_self=True)).withColumn("density", 1 / F.greatest("diversity", F.lit(1e-8)))
    unsure = normalise(far, ["density"], "minmax").select("i", (1 - F.col("density")).alias("score"))
    own, _ = clusters(plane, k, seed)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "i"))
    order = own.join(unsure, "i").withColumn("first", rank == 1)
    best = order.orderBy(F.desc("first"), F.desc("score"), "i").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("first"), F.desc("score"), "i"))).select("i", "rank", "score")


@method("dfool")
def dfool(pairs: DataFrame, k: int, near: int = 128) -> DataFrame:
    """1 / margin of the own pair over the hardest other, in both directions; modalities must share a space."""
    s = None
    for name, a, b in (("score_img", "img", "txt"), ("score_txt", "txt", "img")):
        q, base = view(pairs, a), view(pairs, b)
        hard = knn(q, 2, "cosine", base=base, with_self=True).where("i <> j").groupBy("i").agg(F.max(1 - F.col("dist")).alias("hard"))
        own = pairs.select("i", F.aggregate(F.zip_with(l2(F.col(a), 1e-8), l2(F.col(b), 1e-8), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x).alias("own"))
        one = own.join(hard, "i").select("i", (1 / F.greatest(F.col("own") - F.col("hard"), F.lit(1e-4))).alias(name))
        s = one if s is None else s.join(one, "i")
    return _best(fuse(s.withColumn("score_joint", (F.col("score_img") + F.col("score_txt")) / 2)), k)


def greedy(gradients: DataFrame, target: list[float], k: int) -> DataFrame:
    """gradients(i, v): the largest product with what is left of the target, which it then leaves, k times. Ties by i."""
    spark = gradients.sparkSession
    g, left, out = settle(gradients.select("i", "v")), list(target), []
    for r in range(1, k + 1):
        line = F.array(*[F.lit(float(x)) for x in left])
        s = F.aggregate(F.zip_with("v", line, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        rest = g.where(~F.col("i").isin([o[0] for o in out])) if out else g
        best = rest.withColumn("s", s).agg(F.max_by(F.struct("i", "v", "s"), F.struct("s", -F.col("i"))).alias("b")).first()["b"]
        out.append((best["i"], r, float(best["s"])))
        left = [a - b for a, b in zip(left, best["v"], strict=True)]
    return spark.createDataFrame(out, "i long, rank int, score double")


def mean_vector(features: DataFrame) -> list[float]:
    size = len(features.first()["v"])
    return list(features.agg(*[F.avg(F.get("v", F.lit(c))) for c in range(size)]).first())


def gradients(pairs: DataFrame) -> DataFrame:
    """(i, v): [a - b, b - a] of the unit vectors of both modalities."""
    a, b = l2(F.col("img"), 1e-8), l2(F.col("txt"), 1e-8)
    return pairs.select("i", F.concat(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(b, a, lambda x, y: x - y)).alias("v"))


@method("gradmatch")
def gradmatch(pairs: DataFrame, k: int) -> DataFrame:
    g = gradients(pairs)
    return greedy(g, [x * k for x in mean_vector(g)], k)


@method("glister")
def glister(pairs: DataFrame, k: int, every: int = 10) -> DataFrame:
    """The same towards the mean gradient of the held-out rows: each with shift_mix(i) mod `every` of 0."""
    g = gradients(pairs)
    held = g.where(F.pmod(shift_mix(F.col("i"), 3), F.lit(every)) == 0)
    return greedy(g, mean_vector(held), k)


def split(pairs: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """pairs with `val`: true for the share of least shift_mix, at least one row and not all."""
    wide = with_totals(pairs.select("i", shift_mix(F.col("i"), seed).alias("h")), n=F.count("*"))
    rank = F.row_number().over(Window.orderBy("h", "i"))
    size = F.least(F.greatest(F.bround(F.col("n") * share), F.lit(1)), F.col("n") - 1)
    return pairs.join(wide.withColumn("val", rank <= size).select("i", "val"), "i")
