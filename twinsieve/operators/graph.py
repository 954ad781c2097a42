"""Algebra on edges(i, j, w): pointwise operations are unions and joins on (i, j)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import EPS, with_totals
from twinsieve.session import drop, settle

TINY = 1e-12


def present(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0")


def aligned(**graphs: DataFrame) -> DataFrame:
    """(i, j, one column a graph): the union of the supports, 0 where a graph has no edge."""
    rows = [g.select("i", "j", *[(F.col("w") if n == k else F.lit(0.0)).alias(n) for n in graphs]) for k, g in graphs.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in graphs])


def aligned_shares(a: DataFrame, b: DataFrame, shares: tuple[float, float], eps: float = TINY) -> DataFrame:
    """(i, j, a, b, pa, pb): both graphs aligned, and each edge's part of its row times the graph's share.

    Both are dealt out together and once, by row; sums of rows and of edges are taken there.
    """
    rows = a.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionByName(b.select("i", "j", F.lit(0.0).alias("a"), F.col("w").alias("b")))
    both = rows.repartition("i").groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = lambda c, s: F.col(c) / F.greatest(F.sum(c).over(Window.partitionBy("i")), F.lit(eps)) * s
    return both.select("i", "j", "a", "b", part("a", shares[0]).alias("pa"), part("b", shares[1]).alias("pb"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("i <> j")


def clipped(edges: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return present(edges.withColumn("w", F.least(F.greatest(F.col("w"), F.lit(low)), F.lit(high))))


def power(edges: DataFrame, alpha: float) -> DataFrame:
    return edges.withColumn("w", F.pow(F.greatest(F.col("w"), F.lit(TINY)), F.lit(alpha)))


def scaled(edges: DataFrame, by: float) -> DataFrame:
    return present(edges.withColumn("w", F.col("w") * by))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(i, j, w, rank): the k heaviest edges of each row, ties by j."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def sparsified(edges: DataFrame, k: int | None = None, threshold: float | None = None, absolute: bool = True) -> DataFrame:
    """Edges of at least the threshold, the k best of each row."""
    size = F.abs("w") if absolute else F.col("w")
    out = edges.where(size >= threshold) if threshold else edges
    if k:
        rank = F.row_number().over(Window.partitionBy("i").orderBy(size.desc(), "j"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    return present(out)


def row_sums(edges: DataFrame, name: str = "degree", absolute: bool = False) -> DataFrame:
    return edges.groupBy("i").agg(F.sum(F.abs("w") if absolute else F.col("w")).alias(name))


def degree(edges: DataFrame, nodes: DataFrame, floor: float = 0.0) -> DataFrame:
    """(i, degree) of every node; 0, or the floor, without edges."""
    d = F.coalesce("degree", F.lit(0.0))
    return nodes.select("i").join(row_sums(edges), "i", "left").select("i", F.greatest(d, F.lit(floor)).alias("degree") if floor else d.alias("degree"))


def graph_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, degree, score, cost): degree over the greatest, and 1 less that; score 0 if there is no edge."""
    wide = with_totals(degree(edges, nodes), _m=F.max("degree"))
    score = F.when(F.col("_m") > 0, F.col("degree") / F.col("_m")).otherwise(0.0)
    return wide.select("i", "degree", score.alias("score"), (1 - score).alias("cost"))


def stochastic(edges: DataFrame, eps: float = TINY) -> DataFrame:
    """Every row over its sum: the transition of a walk."""
    total = F.greatest(F.sum("w").over(Window.partitionBy("i")), F.lit(eps))
    return present(edges.select("i", "j", (F.col("w") / total).alias("w")))


def normalised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """w / sqrt(d_i d_j)."""
    d = degree(edges, nodes, TINY)
    out = edges.join(d.withColumnRenamed("degree", "_a"), "i").join(d.select(F.col("i").alias("j"), F.col("degree").alias("_b")), "j")
    return out.select("i", "j", (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("w"))


def laplacian(edges: DataFrame, nodes: DataFrame, normed: bool = True) -> DataFrame:
    """Degree less weight; normed: 1 less w / sqrt(d_i d_j), with 0 for nodes without edges. Loops count as no edge."""
    own = without_loops(edges)
    d = degree(own, nodes)
    off = normalised(own, nodes) if normed else own
    diagonal = d.select("i", F.col("i").alias("j"), (F.when(F.col("degree") > 0, 1.0).otherwise(0.0) if normed else F.col("degree")).alias("w"))
    return present(off.select("i", "j", (-F.col("w")).alias("w")).unionByName(diagonal))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices: a join on the inner index and a sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("w").alias("_w"))
    out = a.select("i", F.col("j").alias("k"), "w").join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("w") * F.col("_w")).alias("w"))
    return present(out)


def apply(edges: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """edges times rows(i, v): weighted sums of vectors, the zero vector for rows without edges."""
    right = vectors.select(F.col("i").alias("j"), "v")
    sums = [F.sum(F.col("w") * F.get("v", F.lit(k))).alias(f"c{k}") for k in range(size)]
    out = edges.join(right, "j").groupBy("i").agg(*sums)
    wide = vectors.select("i").join(out, "i", "left")
    return wide.select("i", F.array(*[F.coalesce(f"c{k}", F.lit(0.0)) for k in range(size)]).alias("v"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return present(a.join(b.select("i", "j", F.col("w").alias("_w")), ["i", "j"]).select("i", "j", (F.col("w") * F.col("_w")).alias("w")))


def averaged(edges: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    both = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return present(both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w")))


def added_limited(base: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Edges that base has, and of each row the k heaviest that it has not."""
    marked = edges.join(base.select("i", "j", F.lit(True).alias("_old")), ["i", "j"], "left").withColumn("_new", F.col("_old").isNull())
    rank = F.row_number().over(Window.partitionBy("i", "_new").orderBy(F.desc("w"), "j"))
    return marked.withColumn("_r", rank).where(~F.col("_new") | (F.col("_r") <= k)).select("i", "j", "w")


def summary(values: DataFrame, column: str) -> list[Column]:
    """Mean, population deviation, least and greatest; 0 over no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.avg(column)).alias("mean"), zero(F.stddev_pop(column)).alias("std"), zero(F.min(column)).alias("min"), zero(F.max(column)).alias("max")]


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degree(edges, nodes)
    one = d.agg(F.count("*").alias("num_nodes"), F.coalesce(F.min("degree"), F.lit(0.0)).alias("min_degree"), F.coalesce(F.max("degree"), F.lit(0.0)).alias("max_degree"), F.coalesce(F.avg(F.when(F.col("degree") > 0, F.col("degree"))), F.lit(0.0)).alias("mean_nonzero_degree"))
    n = F.greatest("num_nodes", F.lit(1))
    wide = one.crossJoin(F.broadcast(edges.agg(F.count("*").alias("num_edges"))))
    return wide.select("num_nodes", "num_edges", (F.col("num_edges") / n).alias("avg_degree"), "min_degree", "max_degree", "mean_nonzero_degree", (F.col("num_edges") / (n * n)).alias("density"))


def row_entropy(edges: DataFrame, nodes: DataFrame, eps: float = EPS) -> DataFrame:
    """(i, entropy): of each row's weights as shares, over that of as many equal ones; 0 for a single edge. No loops."""
    own = without_loops(edges).withColumn("p", F.greatest(F.col("w"), F.lit(eps)))
    own = own.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("i")))
    h = -F.sum(F.col("p") * F.log(F.col("p") + eps)) / F.greatest(F.log(F.count("*") + eps), F.lit(eps))
    out = own.groupBy("i").agg(F.when(F.count("*") > 1, F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("entropy"))
    return nodes.select("i").join(out, "i", "left").select("i", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def neighbour_jaccard(a: DataFrame, b: DataFrame, nodes: DataFrame, k: int, empty: float = 0.0) -> DataFrame:
    """(i, score): shared over all of the k heaviest neighbours in either graph; `empty` where neither has any."""
    both = top_neighbours(a, k).select("i", "j", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(top_neighbours(b, k).select("i", "j", F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy("i", "j").agg((F.sum("a") * F.sum("b")).alias("shared")).groupBy("i").agg((F.sum("shared") / F.count("*")).alias("score"))
    return nodes.select("i").join(each, "i", "left").select("i", F.coalesce("score", F.lit(empty)).alias("score"))


def pair_similarity(a: DataFrame, b: DataFrame, nodes: DataFrame, k: int = 15, eps: float = EPS) -> DataFrame:
    """One row: support Jaccard, correlation of the weights of shared edges, mean overlap of top neighbours."""
    both = aligned(a=a, b=b).withColumn("shared", (F.col("a") > eps) & (F.col("b") > eps))
    x, y = F.when(F.col("shared"), F.col("a")), F.when(F.col("shared"), F.col("b"))
    one = both.agg(F.count_if("shared").alias("support_intersection"), F.count_if((F.col("a") > eps) | (F.col("b") > eps)).alias("support_union"), F.corr(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    corr = F.when((F.col("_x") > eps) & (F.col("_y") > eps), F.least(F.greatest("_c", F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    overlap = neighbour_jaccard(a, b, nodes, k, 1.0).agg(F.avg("score").alias("topk_neighbor_overlap_mean"))
    return one.crossJoin(F.broadcast(overlap)).select("support_intersection", "support_union", (F.col("support_intersection") / F.greatest("support_union", F.lit(1))).alias("support_jaccard"), corr.alias("edge_weight_correlation"), "topk_neighbor_overlap_mean")


def edge_adjustment(reference: DataFrame | None, before: DataFrame, after: DataFrame, eps: float = EPS) -> DataFrame:
    """One row: how many candidate edges changed, up and down, and by how much. Without a reference, the candidates are the edges of either graph."""
    if reference is None:
        both = aligned(a=before, b=after)
    else:
        both = aligned(a=before, b=after, _r=reference.select("i", "j", F.lit(1.0).alias("w"))).where("_r > 0")
    d = F.col("b") - F.col("a")
    one = both.select(d.alias("d")).agg(F.count("*").alias("total"), F.count_if(F.abs("d") > eps).alias("changed"), F.count_if(F.col("d") > eps).alias("up"), F.count_if(F.col("d") < -eps).alias("down"), F.coalesce(F.avg(F.abs("d")), F.lit(0.0)).alias("mean_abs_delta"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_signed_delta"))
    return one.withColumn("changed_ratio", F.col("changed") / F.greatest("total", F.lit(1)))


def distribution_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: mean of the difference by node, with and without its sign."""
    both = before.select("i", F.col(column).alias("a")).join(after.select("i", F.col(column).alias("b")), "i")
    return both.agg(F.coalesce(F.avg(F.abs(F.col("b") - F.col("a"))), F.lit(0.0)).alias("mean_abs_delta"), F.coalesce(F.avg(F.col("b") - F.col("a")), F.lit(0.0)).alias("mean_signed_delta"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Frobenius norm of b - a, and mean and greatest absolute difference over the union of supports."""
    d = aligned(a=a, b=b).withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("frobenius"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"))


def blocks(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, w): weight between groups over the size of the row's group. labels(i, label)."""
    size = labels.groupBy("label").agg(F.count("*").alias("_n"))
    both = edges.join(labels.select("i", F.col("label").alias("a")), "i").join(labels.select(F.col("i").alias("j"), F.col("label").alias("b")), "j")
    return both.groupBy("a", "b").agg(F.sum("w").alias("w")).join(F.broadcast(size), F.col("a") == F.col("label")).select("a", "b", (F.col("w") / F.col("_n")).alias("w"))


def clustering(edges: DataFrame) -> DataFrame:
    """(i, triangles, coefficient) of the plain graph: neighbours that are neighbours of each other."""
    plain = without_loops(edges).select("i", "j").distinct()
    two = plain.join(plain.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").where("i <> k")
    closed = two.join(plain.select("i", F.col("j").alias("k")), ["i", "k"]).groupBy("i").agg((F.count("*") / 2).alias("triangles"))
    d = plain.groupBy("i").agg(F.count("*").alias("d"))
    t = F.coalesce("triangles", F.lit(0.0))
    return d.join(closed, "i", "left").select("i", t.alias("triangles"), F.when(F.col("d") > 1, 2 * t / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, comp): the least node that edges reach. Labels move to the least of the neighbours' and jump to their own label's.

    The number of rounds grows with the logarithm of the longest path; a round that moves no
    label ends the loop, and labels only fall, so it always ends.
    """
    links = settle(without_loops(edges).select("i", "j").distinct())
    label = settle(nodes.select("i", F.col("i").alias("comp")))
    while True:
        near = links.join(label.select(F.col("i").alias("j"), F.col("comp").alias("c")), "j").groupBy("i").agg(F.min("c").alias("c"))
        new = label.join(near, "i", "left").select("i", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        up = new.select(F.col("i").alias("comp"), F.col("comp").alias("up"))
        after = settle(new.join(up, "comp").select("i", "old", F.least("comp", "up").alias("comp")))
        moved = not after.where("comp <> old").isEmpty()
        drop(label)
        label = after
        if not moved:
            drop(links)
            return label.select("i", "comp")


def spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Boruvka's minimum spanning forest of edges(i, j, dist): the least edge of every component, until none joins two.

    Each round at least halves the components that edges still join. Labels of components
    are carried on, and edges within one fall away.
    """
    left = settle(edges.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("dist").alias("dist")).select("a", "b", "dist", F.col("a").alias("ca"), F.col("b").alias("cb")))
    chosen = settle(left.select("a", "b", "dist").limit(0))
    comp = nodes.select(F.col("i").alias("c")).distinct()
    while not left.isEmpty():
        ends = left.select("a", "b", "dist", "ca", "cb", F.explode(F.array("ca", "cb")).alias("c"))
        least = settle(ends.groupBy("c").agg(F.min(F.struct("dist", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct())
        pairs = least.select(F.col("ca").alias("i"), F.col("cb").alias("j"))
        label = components(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))), comp.withColumnRenamed("c", "i"))
        before = chosen, left
        chosen = settle(chosen.unionByName(least.select("a", "b", "dist")))
        move = lambda c: label.select(F.col("i").alias(c), F.col("comp").alias(f"new_{c}"))  # noqa: B023, E731
        left = settle(left.join(move("ca"), "ca").join(move("cb"), "cb").where("new_ca <> new_cb").select("a", "b", "dist", F.col("new_ca").alias("ca"), F.col("new_cb").alias("cb")))
        comp = label.select(F.col("comp").alias("c")).distinct()
        for used in (*before, least):
            drop(used)
    return chosen


def with_spanning_tree(edges: DataFrame, distances: DataFrame, nodes: DataFrame, width: float, scale: float = 1.0) -> DataFrame:
    """The larger of the graph's weight and exp(-dist / width) * scale on the spanning forest's edges."""
    tree = spanning_tree(distances, nodes).select(F.col("a").alias("i"), F.col("b").alias("j"), F.least(F.greatest(F.exp(-F.col("dist") / max(width, 1e-6)) * scale, F.lit(0.0)), F.lit(1.0)).alias("w"))
    both = edges.select("i", "j", "w").unionByName(tree).unionByName(tree.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return present(both.groupBy("i", "j").agg(F.max("w").alias("w")))
