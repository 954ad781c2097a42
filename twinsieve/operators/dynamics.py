"""Selectors by training dynamics of a small surrogate: two linear maps under a contrastive loss.

Every row of every epoch is a step of one sequence, so one task fits the surrogate: the rows
come to it sorted by epoch and place, and it holds a batch of them at a time. Its history is
a table (epoch, i, loss, confidence, error), from which the scores are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import numbered, top
from twinsieve.operators import kernels
from twinsieve.operators.selection import _best, method
from twinsieve.session import reachable, settle

HISTORY = "epoch int, i long, loss double, confidence double, error double"


def _placed(n: int, shape: tuple[int, int], epochs: int, seed: int):
    """Adds to rows (..., at) their place in each epoch: 8 bytes a row and epoch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places = kernels.Surrogate(*shape, seed=seed), []
        for _ in range(epochs):
            own = np.empty(n, np.int64)
            own[model.order(n)] = np.arange(n)
            places.append(own)
        for batch in batches:
            at = batch.column("at").to_numpy()
            own = np.stack([p[at] for p in places], axis=1)
            offsets = np.arange(0, own.size + 1, epochs, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()))], names=["i", "img", "txt", "places"])

    return run


def _fitted(n: int, shape: tuple[int, int], seed: int):
    """Rows (epoch, place, i, img, txt) of all epochs in order -> HISTORY."""

    def matrix(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes, nth, held, rows = kernels.Surrogate(*shape, seed=seed), kernels.Surrogate.sizes(n), 0, [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= sizes[nth % len(sizes)]:
                size = sizes[nth % len(sizes)]
                t = pa.Table.from_batches(held).combine_chunks()
                own = t.slice(0, size).combine_chunks()
                held, rows, nth = t.slice(size).to_batches(), rows - size, nth + 1
                out = model.step(*(matrix(own.column(c).combine_chunks()) for c in ("img", "txt")))
                yield pa.RecordBatch.from_arrays([own.column("epoch").combine_chunks(), own.column("i").combine_chunks(), *map(pa.array, out)], names=["epoch", "i", "loss", "confidence", "error"])

    return run


def history(pairs: DataFrame, epochs: int, seed: int = 0) -> DataFrame:
    """(epoch, i, loss, confidence, error) of the surrogate on pairs(i, img, txt), as kernels.surrogate gives them."""
    spark = reachable(pairs.sparkSession)
    doubles = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    rows = pairs.select(F.col("i").cast("long").alias("i"), doubles("img"), doubles("txt"))
    n, first = rows.count(), rows.first()
    if not n or not epochs:
        return spark.createDataFrame([], HISTORY)
    shape = len(first["img"]), len(first["txt"])
    placed = numbered(rows, [F.col("i")], "at").select("i", "img", "txt", F.col("at").cast("long").alias("at"))
    placed = placed.mapInArrow(_placed(n, shape, epochs, seed), "i long, img array<double>, txt array<double>, places array<long>")
    steps = placed.select(F.posexplode("places").alias("epoch", "place"), "i", "img", "txt").repartition(1).sortWithinPartitions("epoch", "place")
    return settle(steps.mapInArrow(_fitted(n, shape, seed), HISTORY))


def early_error(dynamics: DataFrame, window: int = 3) -> DataFrame:
    """(i, score_pair): mean error over the first epochs."""
    return dynamics.where(F.col("epoch") < window).groupBy("i").agg(F.avg("error").alias("score_pair"))


def forgotten(dynamics: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(i, score_pair): how often the confidence fell below the threshold after it had reached it."""
    before = F.lag("confidence").over(Window.partitionBy("i").orderBy("epoch"))
    lost = (F.col("before") >= threshold) & (F.col("confidence") < threshold)
    return dynamics.withColumn("before", before).groupBy("i").agg(F.count_if(lost).cast("double").alias("score_pair"))


def often_kept(dynamics: DataFrame, k: int, epochs: int) -> DataFrame:
    """(i, score_pair): 0.7 of the share of epochs in which a sample is among the k of the greatest loss, and 0.3 of its mean loss over the greatest one."""
    rank = F.row_number().over(Window.partitionBy("epoch").orderBy(F.desc("loss"), "i"))
    # the filter on the rank lets Spark keep k rows of an epoch before they meet in one task
    hits = dynamics.withColumn("r", rank).where(F.col("r") <= k).groupBy("i").agg(F.count("*").alias("hits"))
    own = dynamics.groupBy("i").agg(F.avg("loss").alias("mean")).join(hits, "i", "left")
    own = own.select("i", (F.coalesce("hits", F.lit(0)) / float(max(epochs, 1))).alias("share"), "mean")
    most = own.agg(F.greatest(F.max("mean"), F.lit(1e-8)).alias("most"))
    # fixed values of the method: the two weights
    return own.crossJoin(F.broadcast(most)).select("i", (0.7 * F.col("share") + 0.3 * F.col("mean") / F.col("most")).alias("score_pair"))


@method("el2n", "grand")
def el2n(pairs: DataFrame, k: int, epochs: int = 5, window: int = 3, seed: int = 0) -> DataFrame:
    """Error norm in the first epochs; the gradient norm of the last layer is the same expression."""
    return _best(early_error(history(pairs, epochs, seed), min(window, epochs)), k)


@method("forget", "ccs-forget")
def forget(pairs: DataFrame, k: int, epochs: int = 8, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    return _best(forgotten(history(pairs, epochs, seed), threshold), k)


@method("dynamic_pruning", "infobatch")
def dynamic_pruning(pairs: DataFrame, k: int, epochs: int = 6, seed: int = 0) -> DataFrame:
    scored = often_kept(history(pairs, epochs, seed), k, epochs)
    return top(scored, "score_pair", k).select("i", "rank", F.col("score_pair").alias("score"))
