"""Tables of runs: means, deviations, pivots, differences, missing cells, energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_std(c: str) -> Column:
    """Deviation of a sample; 0 for one value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def metric_table(runs: DataFrame, keys: list[str], metrics: list[str], population: bool = False) -> DataFrame:
    """Mean, deviation and number of each metric in each group; nulls are skipped."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), (F.stddev_pop(m) if population else sample_std(m)).alias(f"{m}_std"), F.count(m).alias(f"{m}_n")]
    return runs.groupBy(*keys).agg(*out)


def wide(rows: DataFrame, key: str, column: str, values: list, metric: str) -> DataFrame:
    return rows.groupBy(key).pivot(column, values).agg(F.avg(metric))


def deltas(rows: DataFrame, variant: str, base: str, keys: list[str], metric: str) -> DataFrame:
    """Each variant's metric less the base variant's of the same keys; null where either is missing."""
    b = rows.where(F.col(variant) == base).select(*keys, F.col(metric).alias("base"))
    return rows.join(b, keys, "left").select(*keys, variant, metric, (F.col(metric) - F.col("base")).alias("delta"))


def missing(grid: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(found.select(*keys).distinct(), keys, "left_anti")


def bias(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """Mean, population deviation and range over architectures."""
    return rows.groupBy(key).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), (F.max(metric) - F.min(metric)).alias("range"), F.count(metric).alias("n"))


def percent(c: Column) -> Column:
    """A number, or null for what is none; shares of 1 become percent."""
    x = F.when(F.trim(c).isin("", "-", "None", "nan", "NaN", "inf", "-inf"), None).otherwise(c).try_cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return F.when(x.between(0, 1), x * 100).otherwise(x)


def first_of(*columns: Column) -> Column:
    """The first that is not null or empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def energy(samples: DataFrame, group: str, ts: str, watts: str) -> DataFrame:
    """(group, joules, seconds): the area under the power samples, by trapezoids."""
    w = Window.partitionBy(group).orderBy("t", "p")
    s = samples.select(group, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(watts).alias("p"))
    s = s.withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 1e6).withColumn("mid", (F.col("p") + F.lag("p").over(w)) / 2)
    return s.groupBy(group).agg(F.coalesce(F.sum(F.col("mid") * F.col("dt")), F.lit(0.0)).alias("joules"), F.coalesce(F.sum("dt"), F.lit(0.0)).alias("seconds"))


def smoothed(samples: DataFrame, group: str, order: list[str], value: str, width: int = 20) -> DataFrame:
    """samples with the mean of the last `width` values."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(1 - width, 0)
    return samples.withColumn("smooth", F.avg(value).over(w))


def counter_delta(start: Column, end: Column, most: Column) -> Column:
    """What a wrapping counter counted."""
    return F.when(end < start, most - start + end).otherwise(end - start)


def efficiency(stages: DataFrame, run: str, stage: str, seconds: str, joules: str) -> DataFrame:
    """Selection and training shares of each run, and their ratio; a run without training has a null ratio."""
    part = lambda p, c: F.coalesce(F.sum(F.when(F.col(stage).startswith(p), F.col(c))), F.lit(0.0))
    out = stages.groupBy(run).agg(part("selection", seconds).alias("selection_s"), part("train", seconds).alias("train_s"), part("selection", joules).alias("selection_j"), part("train", joules).alias("train_j"))
    return out.withColumn("overhead", F.when(F.col("train_s") > 0, F.col("selection_s") / F.col("train_s")))


def latest_best(rows: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """(run, best_epoch, best, last): the first epoch of the greatest metric, and the last epoch's."""
    return rows.groupBy(run).agg(F.max_by(epoch, F.struct(metric, -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best"), F.max_by(metric, epoch).alias("last"))


def precedence(rows: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """The value of the least priority number for each key."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def alignment(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whether all runs of a key agree in each column."""
    return rows.groupBy(key).agg(*[(F.count_distinct(c) <= 1).alias(f"same_{c}") for c in columns])
