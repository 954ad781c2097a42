"""Ranks and recall of retrieval in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.operators.knn import knn


def ranked(queries: DataFrame, base: DataFrame, k: int = 128) -> DataFrame:
    """(i, rank, j, dist): the k most similar rows of base by cosine, ties by j."""
    return knn(queries, k, "cosine", base=base, with_self=True)


def recall(ranks: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: the share of queries in truth(i, j) with a true j among the first k, times 100. A query never hit counts 0."""
    best = truth.join(ranks.where(F.col("rank") <= max(at)).select("i", "j", "rank"), ["i", "j"], "left").groupBy("i").agg(F.min("rank").alias("best"))
    return _within(best, at)


def recall_in_group(ranks: DataFrame, rows: DataFrame, key: str, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: the share of queries with another row of their group among the first k, times 100; one without a group, or alone in it, counts 0.

    The neighbours' groups are compared; the pairs of a group, whose number grows with its square, are never formed.
    """
    group = rows.select("i", key)
    near = ranks.where(F.col("rank") <= max(at)).join(group.withColumnRenamed(key, "_own"), "i").join(group.select(F.col("i").alias("j"), F.col(key).alias("_other")), "j")
    hit = (F.col("_own") == F.col("_other")) & (F.col("i") != F.col("j"))
    return _within(near.groupBy("i").agg(F.min(F.when(hit, F.col("rank"))).alias("best")), at)


def _within(best: DataFrame, at: tuple[int, ...]) -> DataFrame:
    return best.agg(*[(100 * F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)))).alias(f"r{k}") for k in at])


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: how often the best scored class(i, label, score, truth) is the true one."""
    best = scored.groupBy("i").agg(F.max_by("label", F.struct("score", (-F.col("label")).alias("l"))).alias("best"), F.first("truth").alias("truth"))
    return best.agg((100 * F.avg((F.col("best") == F.col("truth")).cast("double"))).alias("accuracy"))


def margins(pairs: DataFrame) -> DataFrame:
    """sims(i, j, sim) of all pairs -> (i, margin): that of the own pair less the best other."""
    own, other = F.max(F.when(F.col("i") == F.col("j"), F.col("sim"))), F.max(F.when(F.col("i") != F.col("j"), F.col("sim")))
    return pairs.groupBy("i").agg((own - other).alias("margin"))


def same_group(rows: DataFrame, key: str) -> DataFrame:
    """(i, j): rows of one group are relevant to each other, themselves included."""
    return rows.select("i", key).join(rows.select(F.col("i").alias("j"), key), key).select("i", "j")


def forgetting(dynamics: DataFrame) -> DataFrame:
    """learned(epoch, i, learned) -> (i, forgotten): how often a learned sample was lost again."""
    before = F.lag("learned").over(Window.partitionBy("i").orderBy("epoch"))
    return dynamics.withColumn("b", before).groupBy("i").agg(F.count_if(F.col("b") & ~F.col("learned")).alias("forgotten"))


def kept_often(dynamics: DataFrame, k: int) -> DataFrame:
    """losses(epoch, i, loss) -> (i, kept): in how many epochs the sample is among the k of the greatest loss."""
    rank = F.row_number().over(Window.partitionBy("epoch").orderBy(F.desc("loss"), "i"))
    return dynamics.withColumn("r", rank).groupBy("i").agg(F.count_if(F.col("r") <= k).alias("kept"))
