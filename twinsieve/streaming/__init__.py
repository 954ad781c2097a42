"""An extension beyond batch: power samples as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(samples: DataFrame, ts: str, value: str, group: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mean and number of samples in tumbling windows; later than `late` is dropped from a stream."""
    return samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), group, "n", "mean")
