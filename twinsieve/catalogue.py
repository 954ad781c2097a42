"""All queries of the library on the driver's tables, and their SQL.

The vectors of `embeddings` stand in for two modalities: elements 1 to 32 for images and
33 to 64 for texts. `lineitem` and `orders` stand in for tables of runs, `events` for
power samples. Floats are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve import oracle as O
from twinsieve.functions import scores, text
from twinsieve.functions.vectors import distance, dot, l2
from twinsieve.operators import correction, distribution, fusion, fuzzy, kernels, matching, retrieval, selection, spectral, wavelet
from twinsieve.operators import graph as G
from twinsieve.operators.knn import knn
from twinsieve.plans import reports
from twinsieve.plans import selection as plan
from twinsieve.session import reachable, settle
from twinsieve.sources import annotations, runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = O.K


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        name = f.__name__.lstrip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ------------------------------------------------------------------ inputs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, img, txt, label)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.slice(v, 1, 32).alias("img"), F.slice(v, 33, 32).alias("txt"), "label")


def side(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return pairs(spark, sf_dir).select("i", F.col(which).alias("v"))


def graph(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return plan.modality_graph(side(spark, sf_dir, which), K)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and the two graphs, each computed once."""
    return pairs(spark, sf_dir).select("i"), settle(graph(spark, sf_dir, "img")), settle(graph(spark, sf_dir, "txt"))


def one(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and the image graph, computed once."""
    return pairs(spark, sf_dir).select("i"), settle(graph(spark, sf_dir, "img"))


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


EDGE = "SELECT i, j, round(w, 6) AS w FROM {}"


def edges(df: DataFrame) -> DataFrame:
    return df.select("i", "j", *r6("w"))


# ------------------------------------------------------------------ neighbours and graphs


@query(O.with_ctes(O.FEATURES, O.near("img"), select="SELECT i, rank, j, round(d, 6) AS dist FROM near_img"))
def knn_l2(spark, sf_dir):
    return knn(side(spark, sf_dir, "img"), K).select("i", "rank", "j", *r6("dist"))


@query(O.with_ctes(O.FEATURES, O.cosine("txt", K), select="SELECT i, rank, j, round(d, 6) AS dist FROM cos_txt WHERE rank > 1"))
def knn_cosine(spark, sf_dir):
    return knn(side(spark, sf_dir, "txt"), K, "cosine", with_self=True).where("rank > 1").select("i", "rank", "j", *r6("dist"))


@query(O.with_ctes(*O.IMG, select="SELECT i, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM scale_img"))
def rho_sigma(spark, sf_dir):
    return fuzzy.scales(knn(side(spark, sf_dir, "img"), K), K).select("i", *r6("rho", "sigma"))


@query(O.with_ctes(*O.IMG, select=EDGE.format("dir_img")))
def fuzzy_directed(spark, sf_dir):
    near = knn(side(spark, sf_dir, "img"), K)
    return edges(fuzzy.directed(near, fuzzy.scales(near, K)))


@query(O.with_ctes(*O.IMG, select=EDGE.format("once_img")))
def fuzzy_union(spark, sf_dir):
    return edges(fuzzy.local_graph(knn(side(spark, sf_dir, "img"), K), K))


@query(O.with_ctes(*O.IMG, select=EDGE.format("img_g")))
def fuzzy_union_twice(spark, sf_dir):
    return edges(graph(spark, sf_dir, "img"))


def _merged(mode: str, expr: str):
    ctes = (O.FEATURES, O.near("img", 15), O.graph("img", 15), O.near("txt", 10), O.graph("txt", 10))
    sql = O.with_ctes(*ctes, select=f"SELECT i, j, round({expr}, 6) AS w FROM (SELECT i, j, w FROM once_img UNION ALL SELECT i, j, w FROM once_txt) GROUP BY i, j")

    def run(spark, sf_dir):
        a = fuzzy.local_graph(knn(side(spark, sf_dir, "img"), 15), 15)
        b = fuzzy.local_graph(knn(side(spark, sf_dir, "txt"), 10), 10)
        return edges(fuzzy.merge([a, b], mode))

    run.__name__ = f"merge_{mode}"
    query(sql)(run)


_merged("max", "max(w)")
_merged("mean", "sum(w) / 2")
_merged("union", "1 - product(1 - w)")


@query(O.with_ctes(*O.IMG, select="SELECT i, j, round(w / greatest(sum(w) OVER (PARTITION BY i), 1e-12), 6) AS w FROM img_g"))
def row_stochastic(spark, sf_dir):
    return edges(G.stochastic(graph(spark, sf_dir, "img")))


_DEGREE = """
deg AS (SELECT f.i, coalesce(sum(w), 0) AS degree FROM feats f LEFT JOIN img_g g ON g.i = f.i GROUP BY f.i)"""


@query(O.with_ctes(*O.IMG, _DEGREE, select="SELECT i, round(degree, 6) AS degree, round(degree / max(degree) OVER (), 6) AS score, round(1 - degree / max(degree) OVER (), 6) AS cost FROM deg"))
def degree_score(spark, sf_dir):
    return G.graph_score(graph(spark, sf_dir, "img"), pairs(spark, sf_dir)).select("i", *r6("degree", "score", "cost"))


@query(
    O.with_ctes(*O.IMG, _DEGREE, select="""
SELECT n AS num_nodes, e AS num_edges, round(e / n, 6) AS avg_degree, round(lo, 6) AS min_degree, round(hi, 6) AS max_degree, round(m, 6) AS mean_nonzero_degree, round(e / (n * n), 6) AS density
FROM (SELECT count(*) AS n, min(degree) AS lo, max(degree) AS hi, avg(degree) FILTER (degree > 0) AS m FROM deg), (SELECT count(*) AS e FROM img_g)""")
)
def graph_summary(spark, sf_dir):
    out = G.graph_summary(graph(spark, sf_dir, "img"), pairs(spark, sf_dir))
    return out.select("num_nodes", "num_edges", *r6("avg_degree", "min_degree", "max_degree", "mean_nonzero_degree", "density"))


@query(
    O.with_ctes(*O.IMG, select="""
SELECT i, round(CASE WHEN count(*) > 1 THEN least(greatest(-sum(p * ln(p + 1e-8)) / greatest(ln(count(*) + 1e-8), 1e-8), 0), 1) ELSE 0 END, 6) AS entropy
FROM (SELECT i, greatest(w, 1e-8) / sum(greatest(w, 1e-8)) OVER (PARTITION BY i) AS p FROM img_g WHERE i <> j) GROUP BY i""")
)
def row_entropy(spark, sf_dir):
    return G.row_entropy(graph(spark, sf_dir, "img"), pairs(spark, sf_dir)).select("i", *r6("entropy"))


@query(O.with_ctes(*O.IMG, _DEGREE, select="""
SELECT g.i, g.j, round(-w / sqrt(a.degree * b.degree), 6) AS w FROM img_g g JOIN deg a ON a.i = g.i JOIN deg b ON b.i = g.j UNION ALL SELECT i, i, 1.0 FROM deg"""))  # fmt: skip
def laplacian(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    return edges(G.laplacian(a, nodes))


@query(O.with_ctes(*O.IMG, O.top("kept", "img_g", 5), select=EDGE.format("kept")))
def sparsify_topk(spark, sf_dir):
    return edges(G.sparsified(graph(spark, sf_dir, "img"), 5))


@query(O.with_ctes(*O.IMG, select="""
SELECT a.label AS a, b.label AS b, round(sum(g.w) / any_value(n.n), 6) AS w
FROM img_g g JOIN feats a ON a.i = g.i JOIN feats b ON b.i = g.j JOIN (SELECT label, count(*) AS n FROM feats GROUP BY label) n ON n.label = a.label GROUP BY a.label, b.label"""))  # fmt: skip
def block_aggregate(spark, sf_dir):
    return G.blocks(graph(spark, sf_dir, "img"), pairs(spark, sf_dir).select("i", "label")).select("a", "b", *r6("w"))


@query(O.with_ctes(O.FEATURES, O.near("img", 2), """
links AS (SELECT i, j FROM near_img UNION SELECT j, i FROM near_img)""", """
reach AS (SELECT i, i AS c FROM feats UNION SELECT l.j, r.c FROM reach r JOIN links l ON l.i = r.i)""", select="SELECT i, min(c) AS comp FROM reach GROUP BY i"))  # fmt: skip
def connected_components(spark, sf_dir):
    near = knn(side(spark, sf_dir, "img"), 2)
    links = near.select("i", "j").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return G.components(links, pairs(spark, sf_dir))


@query(O.with_ctes(O.FEATURES, O.near("img", 4), """
e AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM near_img UNION ALL SELECT j, i FROM near_img))""", """
t AS (SELECT x.i, count(*) / 2 AS t FROM e x JOIN e y ON y.i = x.j JOIN e z ON z.i = x.i AND z.j = y.j WHERE x.i <> y.j GROUP BY x.i)""", select="""
SELECT d.i, coalesce(t, 0)::DOUBLE AS triangles, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM (SELECT i, count(*) AS d FROM e GROUP BY i) d LEFT JOIN t USING (i)"""))  # fmt: skip
def clustering(spark, sf_dir):
    near = knn(side(spark, sf_dir, "img"), 4)
    links = near.select("i", "j").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return G.clustering(links).select("i", F.col("triangles").cast("double").alias("triangles"), *r6("coefficient"))


@query()
def spanning_tree(spark, sf_dir):
    near = knn(side(spark, sf_dir, "img"), 4)
    return G.spanning_tree(fuzzy.reference_distances(near), pairs(spark, sf_dir)).select("a", "b", *r6("dist"))


# ------------------------------------------------------------------ two graphs


@query(O.with_ctes(*O.BOTH, O.top("ta", "img_g", 10), O.top("tb", "txt_g", 10), """
m AS (SELECT i, j, sum(a) * sum(b) AS s FROM (SELECT i, j, 1 AS a, 0 AS b FROM ta UNION ALL SELECT i, j, 0, 1 FROM tb) GROUP BY i, j)""", select="SELECT i, round(sum(s) / count(*), 6) AS score FROM m GROUP BY i"))  # fmt: skip
def jaccard_agreement(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return G.neighbour_jaccard(a, b, nodes, 10).select("i", *r6("score"))


@query(O.with_ctes(*O.IMG, """
p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM img_g)""", """
p2 AS (SELECT a.i, b.j, sum(a.w * b.w) AS w FROM p a JOIN p b ON b.i = a.j GROUP BY a.i, b.j)""", select="""
SELECT i, round(least(greatest(sum(a * b) / greatest(sqrt(sum(a * a)) * sqrt(sum(b * b)), 1e-8), 0), 1), 6) AS score
FROM (SELECT i, j, coalesce(p.w, 0) AS a, coalesce(p2.w, 0) AS b FROM p FULL JOIN p2 USING (i, j)) GROUP BY i"""))  # fmt: skip
def diffusion_stability(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    return correction.diffusion_stability(G.stochastic(a), nodes).select("i", *r6("score"))


@query(O.with_ctes(*O.IMG, """
p AS (SELECT i, greatest(w / sum(w) OVER (PARTITION BY i), 1e-8) AS p FROM img_g)""", """
h AS (SELECT i, CASE WHEN count(*) > 1 THEN least(greatest(-sum(p * ln(p + 1e-8)) / greatest(ln(count(*) + 1e-8), 1e-8), 0), 1) ELSE 0 END AS h FROM p GROUP BY i)""", select="SELECT i, round(0.05 + 0.95 * exp(-(1 - h) / 0.25), 6) AS kappa FROM h"))  # fmt: skip
def node_confidence(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    return correction.node_confidence(G.stochastic(a), nodes).select("i", *r6("kappa"))


@query()
def node_confidence_views(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return correction.node_confidence(G.stochastic(a), nodes, G.stochastic(b), "multi_view").select("i", *r6("kappa"))


@query(O.with_ctes(*O.IMG, O.collapse("img"), select="SELECT i, round(red, 6) AS redundancy, round(sep, 6) AS separability, round(c, 6) AS collapse FROM red_img JOIN sep_img USING (i) JOIN col_img USING (i)"))
def local_collapse(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    out = correction.redundancy(a, nodes).join(correction.separability(a, nodes), "i").join(correction.local_collapse(a, nodes), "i")
    return out.select("i", *r6("redundancy", "separability", "collapse"))


@query(O.with_ctes(*O.IMG, O.collapse("img"), select="SELECT g.i, g.j, round(exp(-4.0 * 0.5 * (a.c + b.c)), 6) AS q FROM img_g g JOIN col_img a ON a.i = g.i JOIN col_img b ON b.i = g.j"))
def edge_confidence(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    return correction.edge_confidence(a.select("i", "j"), correction.local_collapse(a, nodes)).select("i", "j", *r6("q"))


_WEIGHTED = (*O.BOTH, O.ALIGNED, O.collapse("img"), O.collapse("txt"), O.WEIGHTS)


@query(O.with_ctes(*_WEIGHTED, select="SELECT i, j, round(t2i, 6) AS t2i, round(i2t, 6) AS i2t FROM weights"))
def correction_weights(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return correction.collapse_weights(a, b, nodes).select("i", "j", *r6("t2i", "i2t"))


_MOVED = """
moved AS (SELECT i, j, (1 - t2i) * a + t2i * b AS w, a > 0 AS old FROM weights WHERE (1 - t2i) * a + t2i * b <> 0)""", """
limited AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i, old ORDER BY w DESC, j) AS r FROM moved) WHERE old OR r <= 5)"""


@query(O.with_ctes(*_WEIGHTED, *_MOVED, select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('limited')})"))
def guided_alignment(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return edges(correction.guided(correction.collapse_weights(a, b, nodes), a)[0])


@query(O.with_ctes(*_WEIGHTED, *_MOVED, select=EDGE.format("limited")))
def added_edge_limit(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    w = correction.collapse_weights(a, b, nodes)
    return edges(G.added_limited(a, G.present(w.select("i", "j", ((1 - F.col("t2i")) * F.col("image") + F.col("t2i") * F.col("text")).alias("w")))))


@query(O.with_ctes(*_WEIGHTED, """
moved AS (SELECT i, j, b + i2t * (a - b) AS w FROM weights WHERE b + i2t * (a - b) <> 0)""", select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('moved')})"))  # fmt: skip
def bidirectional_correction(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return edges(correction.bidirectional(correction.collapse_weights(a, b, nodes))[1])


_C = """
c AS (
  SELECT i, j, a, b, CASE WHEN a > 0 THEN 0.5 * a / sum(a) OVER (PARTITION BY i) ELSE 0 END AS ci, CASE WHEN b > 0 THEN 0.5 * b / sum(b) OVER (PARTITION BY i) ELSE 0 END AS ct FROM ab
)"""


@query(O.with_ctes(*O.BOTH, O.ALIGNED, _C, select="SELECT i, j, round(greatest(ct - ci * ct, 0) / (greatest(ct - ci * ct, 0) + 1e-8), 6) AS t2i, round(greatest(ci - ci * ct, 0) / (greatest(ci - ci * ct, 0) + 1e-8), 6) AS i2t FROM c"))
def confidence_weights(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return correction.confidence_weights(a, b, (0.5, 0.5), gated=False).select("i", "j", *r6("t2i", "i2t"))


@query(O.with_ctes(*O.BOTH, """
p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM img_g)""", """
m AS (SELECT i, j, t.w * p.w AS w FROM txt_g t JOIN p USING (i, j))""", select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('m')})"))  # fmt: skip
def directional_correction(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return edges(correction.directional(b, a))


@query(O.with_ctes(*O.BOTH, """
m AS (SELECT i, j, a.w * b.w AS w FROM img_g a JOIN txt_g b USING (i, j))""", select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('m')})"))  # fmt: skip
def fusion_intersection(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return edges(fusion.intersection(a, b))


@query(O.with_ctes(*O.BOTH, O.ALIGNED, select="SELECT i, j, round(sum(w), 6) AS w FROM (SELECT i, j, (a + b) / 4 AS w FROM ab UNION ALL SELECT j, i, (a + b) / 4 FROM ab) GROUP BY i, j"))
def fusion_average(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return edges(fusion.average(a, b))


@query(O.with_ctes(*O.BOTH, O.ALIGNED, _C, """
m AS (SELECT i, j, (ci * ct + 1e-8) * (ci / (ci + ct + 1e-8) * a + ct / (ci + ct + 1e-8) * b) AS w FROM c)""", select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('m')})"))  # fmt: skip
def fusion_confidence(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return edges(fusion.confidence_aware(a, b))


@query(O.with_ctes(*_WEIGHTED, """
m AS (SELECT i, j, (1 - t2i) / (2 - t2i - i2t + 1e-8) * a + (1 - i2t) / (2 - t2i - i2t + 1e-8) * b AS w FROM weights)""", select=f"SELECT i, j, round(w, 6) AS w FROM ({O.union_of('m')})"))  # fmt: skip
def fusion_autonomy(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return edges(fusion.autonomy(correction.collapse_weights(a, b, nodes)))


@query()
def fusion_wavelet_latent(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return edges(fusion.wavelet_latent(a, b, wavelet.probes(nodes, 8), 8, [1, 2]))


_PAIR = O.with_ctes(*O.BOTH, O.ALIGNED, O.top("ta", "img_g", 10), O.top("tb", "txt_g", 10), """
m AS (SELECT i, j, sum(a) * sum(b) AS s FROM (SELECT i, j, 1 AS a, 0 AS b FROM ta UNION ALL SELECT i, j, 0, 1 FROM tb) GROUP BY i, j)""", """
o AS (SELECT avg(s) AS o FROM (SELECT i, sum(s) / count(*) AS s FROM m GROUP BY i))""", select="""
SELECT count(*) FILTER (a > 1e-8 AND b > 1e-8) AS support_intersection, count(*) FILTER (a > 1e-8 OR b > 1e-8) AS support_union,
  round(count(*) FILTER (a > 1e-8 AND b > 1e-8) / count(*) FILTER (a > 1e-8 OR b > 1e-8), 6) AS support_jaccard,
  round(corr(a, b) FILTER (a > 1e-8 AND b > 1e-8), 6) AS edge_weight_correlation, round(any_value(o), 6) AS topk_neighbor_overlap_mean FROM ab, o""")  # fmt: skip


@query(_PAIR)
def graph_pair_similarity(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    return G.pair_similarity(a, b, nodes, 10).select("support_intersection", "support_union", *r6("support_jaccard", "edge_weight_correlation", "topk_neighbor_overlap_mean"))


@query(O.with_ctes(*O.BOTH, O.ALIGNED, select="""
SELECT count(*) AS total, count(*) FILTER (abs(b - a) > 1e-8) AS changed, count(*) FILTER (b - a > 1e-8) AS up, count(*) FILTER (b - a < -1e-8) AS down,
  round(avg(abs(b - a)), 6) AS mean_abs_delta, round(avg(b - a), 6) AS mean_signed_delta, round(count(*) FILTER (abs(b - a) > 1e-8) / count(*), 6) AS changed_ratio FROM ab"""))  # fmt: skip
def edge_adjustment(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return G.edge_adjustment(None, a, b).select("total", "changed", "up", "down", *r6("mean_abs_delta", "mean_signed_delta", "changed_ratio"))


@query(O.with_ctes(*O.BOTH, O.ALIGNED, select="SELECT round(sqrt(sum((b - a) * (b - a))), 6) AS frobenius, round(avg(abs(b - a)), 6) AS mean_abs, round(max(abs(b - a)), 6) AS max_abs FROM ab"))
def graph_difference(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return G.difference(a, b).select(*r6("frobenius", "mean_abs", "max_abs"))


# ------------------------------------------------------------------ wavelets and spectra


@query(O.with_ctes(*O.IMG, """
p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM img_g)""", """
x0 AS (SELECT i, txt[1] AS x FROM feats)""", """
x1 AS (SELECT p.i, sum(p.w * x) AS x FROM p JOIN x0 ON x0.i = p.j GROUP BY p.i)""", """
x2 AS (SELECT p.i, sum(p.w * x) AS x FROM p JOIN x1 ON x1.i = p.j GROUP BY p.i)""", select="SELECT x1.i, round(x1.x - x2.x, 6) AS v FROM x1 JOIN x2 USING (i)"))  # fmt: skip
def wavelet_scale1(spark, sf_dir):
    _, a, _ = both(spark, sf_dir)
    signal = side(spark, sf_dir, "txt").select("i", F.slice("v", 1, 1).alias("v"))
    return wavelet.signatures(a, signal, 1, [1], normalise=False)[1].select("i", F.round(F.col("v")[0], 6).alias("v"))


@query(O.with_ctes(O.FEATURES, """
e AS (SELECT list_sum(list_transform(img, lambda x: x * x)) AS e FROM feats)""", """
t AS (SELECT count(*) AS n, sum(e) AS s, avg(e) AS a, max(e) AS m FROM e)""", """
h AS (SELECT sum(-(e / s) * ln(e / s + 1e-8)) / ln(any_value(n)) AS h FROM e, t)""", select="""
SELECT n AS num_nodes, round(s, 6) AS total_scale_energy, round(a, 6) AS mean_scale_energy, round(m, 6) AS max_scale_energy, round(least(greatest(h, 0), 1), 6) AS normalized_scale_entropy, round(1 - least(greatest(h, 0), 1), 6) AS scale_collapse_score FROM t, h"""))  # fmt: skip
def scale_energy_entropy(spark, sf_dir):
    out = wavelet.energy_entropy(side(spark, sf_dir, "img"))
    return out.select("num_nodes", *r6("total_scale_energy", "mean_scale_energy", "max_scale_energy", "normalized_scale_entropy", "scale_collapse_score"))


@query()
def collapse_metrics(spark, sf_dir):
    nodes, a, b = both(spark, sf_dir)
    out = []
    for name, g in (("image", a), ("text", b)):
        values, _ = spectral.spectrum(g, nodes, 64, vectors=False)
        h, c = kernels.collapse(values)
        out.append((name, round(h, 6), round(c, 6), len(values)))
    return spark.createDataFrame(out, "graph string, spectral_entropy double, collapse_score double, num_eigs int")


@query()
def diffusion_embedding(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    values, rows = spectral.spectrum(a, nodes, 9, "walk")
    return spectral.embedded(rows, values, 8).select("i", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


# ------------------------------------------------------------------ losses between point sets

#: Proxies and frequencies are a chosen few, whatever the number of rows: those of the least ids.
N_PROXIES, N_FREQUENCIES = 20, 10
_PROXIES = f"""
proxies AS (SELECT i AS p, img AS v FROM feats ORDER BY i LIMIT {N_PROXIES})"""
_FREQ = f"""
f AS (SELECT i AS f, txt AS v FROM feats ORDER BY i LIMIT {N_FREQUENCIES})"""
_COVER = """
cover AS (SELECT f.i, sum(exp(-pow(list_distance(f.img, p.v), 2) / 0.5)) AS c FROM feats f, proxies p GROUP BY f.i)"""


def proxies(spark, sf_dir) -> DataFrame:
    return side(spark, sf_dir, "img").orderBy("i").limit(N_PROXIES).select(F.col("i").alias("p"), "v")


def frequencies(spark, sf_dir) -> DataFrame:
    return side(spark, sf_dir, "txt").orderBy("i").limit(N_FREQUENCIES).select(F.col("i").alias("f"), "v")


@query(O.with_ctes(O.FEATURES, _FREQ, select="SELECT f, round(avg(cos(list_dot_product(x.img, f.v))), 6) AS re, round(avg(sin(list_dot_product(x.img, f.v))), 6) AS im FROM feats x, f GROUP BY f"))
def ecf(spark, sf_dir):
    freq = frequencies(spark, sf_dir)
    return distribution.ecf(side(spark, sf_dir, "img"), freq).select("f", *r6("re", "im"))


@query(O.with_ctes(O.FEATURES, _FREQ, """
a AS (SELECT f, avg(cos(list_dot_product(x.img, f.v))) AS re, avg(sin(list_dot_product(x.img, f.v))) AS im FROM feats x, f GROUP BY f)""", """
b AS (SELECT f, avg(cos(list_dot_product(x.txt, f.v))) AS re, avg(sin(list_dot_product(x.txt, f.v))) AS im FROM feats x, f GROUP BY f)""", select="SELECT round(avg(sqrt(pow(a.re - b.re, 2) + pow(a.im - b.im, 2))), 6) AS cfd FROM a JOIN b USING (f)"))  # fmt: skip
def cfd(spark, sf_dir):
    freq = frequencies(spark, sf_dir)
    return distribution.cfd(side(spark, sf_dir, "img"), side(spark, sf_dir, "txt"), freq).select(*r6("cfd"))


@query(O.with_ctes(O.FEATURES, """
a AS (SELECT img AS v FROM feats)""", """
b AS (SELECT txt AS v FROM feats)""", select="""
SELECT round((SELECT avg(exp(-pow(list_distance(x.v, y.v), 2) / 2)) FROM a x, a y) + (SELECT avg(exp(-pow(list_distance(x.v, y.v), 2) / 2)) FROM b x, b y) - 2 * (SELECT avg(exp(-pow(list_distance(x.v, y.v), 2) / 2)) FROM a x, b y), 6) AS mmd2"""))  # fmt: skip
def mmd2(spark, sf_dir):
    return distribution.mmd2(side(spark, sf_dir, "img"), side(spark, sf_dir, "txt"), 1.0).select(*r6("mmd2"))


@query(O.with_ctes(O.FEATURES, """
q AS (SELECT q, greatest(least((q + 0.5) / 16 * n - 0.5, n - 1), 0) AS t, n FROM range(16) r(q), (SELECT count(*) AS n FROM feats))""", """
a AS (SELECT img[1] AS x, row_number() OVER (ORDER BY img[1]) - 1 AS k FROM feats)""", """
b AS (SELECT txt[1] AS x, row_number() OVER (ORDER BY txt[1]) - 1 AS k FROM feats)""", select="""
SELECT round(avg(abs((a0.x + (t - floor(t)) * (a1.x - a0.x)) - (b0.x + (t - floor(t)) * (b1.x - b0.x)))), 6) AS swd
FROM q JOIN a a0 ON a0.k = floor(t) JOIN a a1 ON a1.k = least(floor(t) + 1, n - 1) JOIN b b0 ON b0.k = floor(t) JOIN b b1 ON b1.k = least(floor(t) + 1, n - 1)"""))  # fmt: skip
def sliced_wasserstein(spark, sf_dir):
    d = distribution.sliced_wasserstein(side(spark, sf_dir, "img"), side(spark, sf_dir, "txt"), [[1.0] + [0.0] * 31], 16)
    return spark.createDataFrame([(d,)], "swd double").select(*r6("swd"))


@query(O.with_ctes(O.FEATURES, _PROXIES, _COVER, select="SELECT i, round(c, 6) AS cover FROM cover"))
def coverage(spark, sf_dir):
    return distribution.coverage(side(spark, sf_dir, "img"), proxies(spark, sf_dir), 0.5).select("i", *r6("cover"))


@query(O.with_ctes(O.FEATURES, _PROXIES, select="SELECT round(avg(d), 6) AS nearest_loss FROM (SELECT p, min(pow(list_distance(f.txt, p.v), 2)) AS d FROM feats f, proxies p GROUP BY p)"))
def nearest_loss(spark, sf_dir):
    return distribution.nearest_loss(side(spark, sf_dir, "txt"), proxies(spark, sf_dir)).select(*r6("nearest_loss"))


@query(O.with_ctes(*O.IMG, _PROXIES, _COVER, select="""
SELECT (SELECT round(-avg(ln(c + 1e-8)), 6) FROM cover) AS coverage_loss,
  (SELECT round(-avg(ln(a + 1e-8)), 6) FROM (SELECT f.i, coalesce(sum(g.w * c.c), 0) AS a FROM feats f LEFT JOIN img_g g ON g.i = f.i LEFT JOIN cover c ON c.i = g.j GROUP BY f.i)) AS propagated_loss,
  (SELECT round(sum(g.w * pow(x.c - y.c, 2)) / sum(g.w), 6) FROM img_g g JOIN cover x ON x.i = g.i JOIN cover y ON y.i = g.j) AS relation_loss"""))  # fmt: skip
def relation_losses(spark, sf_dir):
    _, a, _ = both(spark, sf_dir)
    return distribution.relation_losses(side(spark, sf_dir, "img"), a, proxies(spark, sf_dir), 0.5).select(*r6("coverage_loss", "propagated_loss", "relation_loss"))


@query(O.with_ctes(O.FEATURES, _PROXIES, select="""
SELECT p, rank, i, round(d, 6) AS dist FROM (SELECT p.p, f.i, list_distance(p.v, f.txt) AS d, row_number() OVER (PARTITION BY p.p ORDER BY list_distance(p.v, f.txt), f.i) AS rank FROM proxies p, feats f) WHERE rank <= 8"""))  # fmt: skip
def match_candidates(spark, sf_dir):
    return matching.candidates(proxies(spark, sf_dir), side(spark, sf_dir, "txt"), 8).select("p", "rank", "i", *r6("dist"))


@query()
def assignment(spark, sf_dir):
    p, x = proxies(spark, sf_dir), side(spark, sf_dir, "txt")
    near = matching.candidates(p, x, 32)
    return matching.match(matching.costs(near, p, x)).select("p", "i", *r6("cost"))


@query()
def subset_plan(spark, sf_dir):
    return plan.choose(pairs(spark, sf_dir), budget=25).select("p", "i", F.round("cost", 4).alias("cost"))


# ------------------------------------------------------------------ selectors


@query(O.with_ctes(O.FEATURES, O.cosine("img", 32), O.entropy("img"), select=O.best("0.7 * e + 0.3 * v", "ent_img JOIN div_img USING (i)")))
def sel_presel(spark, sf_dir):
    return selection.select("presel", pairs(spark, sf_dir), 50).select("i", "rank", *r6("score"))


_OVERLAP = """
ovl AS (SELECT f.i, count(b.j) / 32 AS o FROM feats f JOIN cos_img a ON a.i = f.i LEFT JOIN cos_txt b ON b.i = a.i AND b.j = a.j GROUP BY f.i)"""


@query(O.with_ctes(O.FEATURES, O.cosine("img", 32), O.cosine("txt", 32), O.entropy("img"), _OVERLAP, select=O.best("0.8 * (0.6 * e + 0.4 * v) + 0.2 * o", "ent_img JOIN div_img USING (i) JOIN ovl USING (i)")))
def sel_visa(spark, sf_dir):
    return selection.select("visa", pairs(spark, sf_dir), 50).select("i", "rank", *r6("score"))


_PROPHET = """
mixed AS (SELECT i, 0.4 * a.e + 0.4 * b.e + 0.2 * c.e AS p, o, d.v FROM ent_img a JOIN ent_txt b USING (i) JOIN ent_joint c USING (i) JOIN div_joint d USING (i) JOIN ovl USING (i))"""


@query(O.with_ctes(O.FEATURES, O.cosine("img", 32), O.cosine("txt", 32), O.cosine("joint", 32), O.entropy("img"), O.entropy("txt"), O.entropy("joint"), _OVERLAP, _PROPHET, select=O.best("0.45 * p + 0.3 * o + 0.25 * v", "mixed")))
def sel_dataprophet(spark, sf_dir):
    return selection.select("dataprophet", pairs(spark, sf_dir), 50).select("i", "rank", *r6("score"))


@query(O.with_ctes(O.FEATURES, O.cosine("img", 64), O.cosine("txt", 64), O.entropy("img"), O.entropy("txt"), """
z AS (SELECT a.i, (a.e - avg(a.e) OVER ()) / stddev_pop(a.e) OVER () AS x, (b.e - avg(b.e) OVER ()) / stddev_pop(b.e) OVER () AS y FROM ent_img a JOIN ent_txt b USING (i))""", select=O.best("0.5 * x + 0.5 * y", "z")))  # fmt: skip
def sel_entropy(spark, sf_dir):
    return selection.select("entropy", pairs(spark, sf_dir), 50).select("i", "rank", *r6("score"))


@query(f"SELECT i, row_number() OVER (ORDER BY h, i) AS rank, h::DOUBLE AS score FROM (SELECT vec_id AS i, {O.mix('vec_id')} AS h FROM embeddings) ORDER BY h, i LIMIT 50")
def sel_rand(spark, sf_dir):
    return selection.select("rand", pairs(spark, sf_dir), 50)


def _greedy(name: str, k: int):
    def run(spark, sf_dir):
        return selection.select(name, pairs(spark, sf_dir), k).select("i", "rank", F.round("score", 4).alias("score"))

    run.__name__ = f"sel_{name}"
    query()(run)


for _name in ("kcenter", "herd", "gradmatch", "glister", "dfool", "dq", "nms", "adap_sne"):
    _greedy(_name, 10)


@query()
def sel_suppressed(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return selection.suppressed(p.select("i", F.col("img")[0].alias("score"), F.col("img").alias("v")), 10).select("i", "rank", *r6("score"))


_FUSED = """
s AS (SELECT i, img[1] AS a, txt[1] AS b FROM feats)""", """
z AS (SELECT i, (a - min(a) OVER ()) / greatest(max(a) OVER () - min(a) OVER (), 1e-8) AS a, (b - min(b) OVER ()) / greatest(max(b) OVER () - min(b) OVER (), 1e-8) AS b FROM s)"""


def _fusion(mode: str, expr: str):
    def run(spark, sf_dir):
        s = pairs(spark, sf_dir).select("i", F.col("img")[0].alias("score_img"), F.col("txt")[0].alias("score_txt"))
        return scores.fuse(s, mode, mode="minmax").select("i", *r6("score_pair"))

    run.__name__ = f"score_fusion_{mode}"
    query(O.with_ctes(O.FEATURES, *_FUSED, select=f"SELECT i, round({expr}, 6) AS score_pair FROM z"))(run)


_fusion("average", "(a + b) / 2")
_fusion("max", "greatest(a, b)")
_fusion("geometric_mean", "sqrt((a - min(a) OVER () + 1e-6) * (b - min(b) OVER () + 1e-6))")
_fusion("normalized_sum", "(a + b - min(a + b) OVER ()) / greatest(max(a + b) OVER () - min(a + b) OVER (), 1e-8)")
_fusion("weighted_sum", "0.5 * a + 0.5 * b")


@query(O.with_ctes(O.FEATURES, select="SELECT i, round((row_number() OVER (ORDER BY img[1], i) - 1) / (count(*) OVER () - 1), 6) AS score FROM feats"))
def rank_normalise(spark, sf_dir):
    s = pairs(spark, sf_dir).select("i", F.col("img")[0].alias("score"))
    return scores.normalise(s, ["score"], "rank").select("i", *r6("score"))


# ------------------------------------------------------------------ retrieval


@query(O.with_ctes(O.FEATURES, """
u AS (SELECT i, list_transform(img, lambda x: x / sqrt(list_sum(list_transform(img, lambda y: y * y)))) AS a, list_transform(txt, lambda x: x / sqrt(list_sum(list_transform(txt, lambda y: y * y)))) AS b FROM feats)""", """
r AS (SELECT x.i, y.i AS j, row_number() OVER (PARTITION BY x.i ORDER BY 1 - list_dot_product(x.a, y.b), y.i) AS rank FROM u x, u y)""", select="SELECT round(100 * avg((rank <= 1)::INT), 6) AS r1, round(100 * avg((rank <= 5)::INT), 6) AS r5, round(100 * avg((rank <= 10)::INT), 6) AS r10 FROM r WHERE i = j"))  # fmt: skip
def retrieval_recall(spark, sf_dir):
    p = pairs(spark, sf_dir)
    ranks = retrieval.ranked(p.select("i", F.col("img").alias("v")), p.select("i", F.col("txt").alias("v")))
    return retrieval.recall(ranks, p.select("i", F.col("i").alias("j"))).select(*r6("r1", "r5", "r10"))


@query(O.with_ctes(O.FEATURES, O.cosine("img", 6), """
h AS (SELECT c.i, min(rank) FILTER (x.label = y.label AND c.i <> c.j) AS best FROM cos_img c JOIN feats x ON x.i = c.i JOIN feats y ON y.i = c.j GROUP BY c.i)""", select="SELECT round(100 * avg((coalesce(best, 99) <= 2)::INT), 6) AS r2, round(100 * avg((coalesce(best, 99) <= 6)::INT), 6) AS r6 FROM h"))  # fmt: skip
def recall_relevance(spark, sf_dir):
    p = pairs(spark, sf_dir)
    ranks = selection.neighbours(p.select("i", F.col("img").alias("v")), 6)
    return retrieval.recall_in_group(ranks, p, "label", (2, 6)).select(*r6("r2", "r6"))


@query("SELECT user_id AS i, count(*) FILTER (prev AND NOT learned) AS forgotten FROM (SELECT user_id, value > 50 AS learned, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id")
def forgetting(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return retrieval.forgetting(e.select(F.col("event_id").alias("epoch"), F.col("user_id").alias("i"), (F.col("value") > 50).alias("learned")))


@query("SELECT l_suppkey AS i, count(*) FILTER (r <= 3) AS kept FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_linenumber ORDER BY l DESC, l_suppkey) AS r FROM (SELECT l_linenumber, l_suppkey, max(l_extendedprice) AS l FROM lineitem GROUP BY ALL)) GROUP BY l_suppkey")
def dynamic_keep(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch"), F.col("l_suppkey").alias("i")).agg(F.max("l_extendedprice").alias("loss"))
    return retrieval.kept_often(own, 3)


# ------------------------------------------------------------------ reports


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(l_quantity) AS l_quantity_n FROM lineitem GROUP BY ALL")
def metric_table_sample_std(spark, sf_dir):
    out = reports.metric_table(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return out.select("l_returnflag", "l_linestatus", *r6("l_quantity_mean", "l_quantity_std"), "l_quantity_n")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(o_totalprice) AS n FROM orders GROUP BY 1")
def metric_table_pop_std(spark, sf_dir):
    out = reports.metric_table(read(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice"], population=True)
    return out.select("o_orderpriority", F.round("o_totalprice_mean", 4).alias("mean"), F.round("o_totalprice_std", 4).alias("std"), F.col("o_totalprice_n").alias("n"))


@query("SELECT l_returnflag, round(avg(l_discount) FILTER (l_linenumber = 1), 6) AS b1, round(avg(l_discount) FILTER (l_linenumber = 2), 6) AS b2, round(avg(l_discount) FILTER (l_linenumber = 3), 6) AS b3 FROM lineitem GROUP BY 1")
def pivot_wide(spark, sf_dir):
    out = reports.wide(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", [1, 2, 3], "l_discount")
    return out.select("l_returnflag", *[F.round(str(k), 6).alias(f"b{k}") for k in (1, 2, 3)])


_GROUPED = "(SELECT l_linestatus, l_linenumber, l_returnflag, avg(l_tax) AS m FROM lineitem GROUP BY ALL)"


@query(f"SELECT l_linestatus, l_linenumber, l_returnflag, round(v.m, 8) AS m, round(v.m - b.m, 8) AS delta FROM {_GROUPED} v LEFT JOIN (SELECT l_linestatus, l_linenumber, m FROM {_GROUPED} WHERE l_returnflag = 'N') b USING (l_linestatus, l_linenumber)")
def ablation_delta(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber", "l_returnflag").agg(F.avg("l_tax").alias("m"))
    return reports.deltas(own, "l_returnflag", "N", ["l_linestatus", "l_linenumber"], "m").select("l_linestatus", "l_linenumber", "l_returnflag", F.round("m", 8).alias("m"), F.round("delta", 8).alias("delta"))


@query("SELECT n_nationkey, p FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE (n_nationkey, p) NOT IN (SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 490000)")
def missing_grid(spark, sf_dir):
    found = read(spark, sf_dir, "orders").where("o_totalprice > 490000").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("p"))
    grid = read(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p")).distinct()))
    return reports.missing(grid, found, ["n_nationkey", "p"])


@query("SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(max(m) - min(m), 6) AS range, count(*) AS n FROM (SELECT event_type, user_id % 7 AS arch, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def arch_bias(spark, sf_dir):
    own = read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("arch")).agg(F.avg("value").alias("m"))
    return reports.bias(own, "event_type", "m").select("event_type", *r6("mean", "std", "range"), "n")


@query("SELECT event_type, round(coalesce(sum((value + p) / 2 * dt), 0), 2) AS joules, round(coalesce(sum(dt), 0), 3) AS seconds FROM (SELECT event_type, value, lag(value) OVER w AS p, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)) GROUP BY event_type")
def trapezoid_energy(spark, sf_dir):
    return reports.energy(read(spark, sf_dir, "events"), "event_type", "ts", "value").select("event_type", F.round("joules", 2).alias("joules"), F.round("seconds", 3).alias("seconds"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def smoothed_meter(spark, sf_dir):
    return reports.smoothed(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").select("event_id", *r6("smooth"))


@query("SELECT event_id, round(CASE WHEN value < p THEN 1000 - p + value ELSE value - p END, 3) AS delta FROM (SELECT event_id, round(value, 3) AS value, lag(round(value, 3)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def counter_delta(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round("value", 3).alias("value"))
    return e.withColumn("p", F.lag("value").over(w)).select("event_id", F.round(reports.counter_delta(F.col("p"), F.col("value"), F.lit(1000)), 3).alias("delta"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS best_epoch, round(max(value), 6) AS best, round(arg_max(value, event_id), 6) AS last FROM events GROUP BY user_id")
def best_epoch(spark, sf_dir):
    out = reports.latest_best(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return out.select("user_id", "best_epoch", *r6("best", "last"))


# ------------------------------------------------------------------ text and records


@query(r"""SELECT doc_id, array_to_string(list_slice(string_split(trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'))), ' '), 1, 30), ' ') AS caption FROM documents""")
def caption_norm(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", annotations.normal_caption(F.col("text"), 30).alias("caption"))


@query("""
WITH u AS (SELECT conv_id, min(turn) AS t, arg_min(text, turn) AS prompt FROM conversations WHERE lower(role) IN ('human', 'user') GROUP BY conv_id)
SELECT conv_id, trim(replace(any_value(prompt), '<image>', '')) AS prompt, trim(arg_min(text, turn)) AS answer FROM conversations JOIN u USING (conv_id) WHERE lower(role) IN ('gpt', 'assistant') AND turn > t GROUP BY conv_id""")
def conversation_turns(spark, sf_dir):
    return annotations.turns(read(spark, sf_dir, "conversations"))


@query("SELECT event_id, 'k' AS path, json_extract(props, '$.k')::DOUBLE AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_flatten(spark, sf_dir):
    return runs.flattened(read(spark, sf_dir, "events"), "event_id", "props", 2)


_IDF = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
kept AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 200),
n AS (SELECT count(DISTINCT doc_id) AS n FROM words),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""


@query(_IDF)
def tfidf(spark, sf_dir):
    return text.tfidf(read(spark, sf_dir, "documents"), "doc_id", "text", 200).select("doc_id", "term", *r6("weight"))


@query("SELECT n, CAST(greatest(1, least(n, round_even(n * 0.05, 0))) AS BIGINT) AS size FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def subset_size(spark, sf_dir):
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("n", F.greatest(F.lit(1), F.least("n", F.bround(F.col("n") * 0.05))).cast("long").alias("size"))


@query(O.with_ctes(O.FEATURES, select="SELECT i, round(list_dot_product(img, txt) / (sqrt(list_sum(list_transform(img, lambda x: x * x))) * sqrt(list_sum(list_transform(txt, lambda x: x * x)))), 6) AS cos, round(list_distance(img, txt), 6) AS dist FROM feats"))
def pair_similarity(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("i", F.round(dot(l2(F.col("img")), l2(F.col("txt"))), 6).alias("cos"), F.round(distance(F.col("img"), F.col("txt")), 6).alias("dist"))


from twinsieve import catalogue_more  # noqa: E402, F401  registers its queries
