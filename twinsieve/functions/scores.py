"""Scores of samples: normal forms, fusion, sizes of subsets.

Normal forms look at all rows through one aggregate that is joined back as a single row,
so nothing is gathered in one task; ranks are the exception that needs an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.session import settle

EPS = 1e-8


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates over all its rows as columns: one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in totals.items()])))


def normalise(df: DataFrame, columns: list[str], mode: str = "zscore", key: str = "i") -> DataFrame:
    """Each column less its mean over its deviation (zscore), on [0, 1] (minmax), by rank, or unchanged (none)."""
    if mode == "none":
        return df
    if mode == "rank":
        return reduce(lambda d, c: ranked(d, c, key), columns, df)
    if mode not in ("zscore", "minmax"):
        raise ValueError(f"unknown normal form: {mode}")
    a, b = (F.avg, F.stddev_pop) if mode == "zscore" else (F.min, F.max)
    wide = with_totals(df, **{f"_a_{c}": a(c) for c in columns}, **{f"_b_{c}": b(c) for c in columns})
    for c in columns:
        over = F.col(f"_b_{c}") if mode == "zscore" else F.col(f"_b_{c}") - F.col(f"_a_{c}")
        wide = wide.withColumn(c, (F.col(c) - F.col(f"_a_{c}")) / F.greatest(over, F.lit(EPS)))
    return wide.select(*df.columns)


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with its rows numbered from 0 in a total order.

    Rows are range-partitioned, numbered within partitions, and moved on by the counts of
    the partitions before, so no task holds more than its range. The ranges are those of a
    sample, drawn anew in every plan: the counts are taken of the rows as they were written.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    cut = cut.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    cut = settle(cut)
    count = cut.groupBy("_part").agg(F.count("*").alias("_c"))
    count = count.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return cut.join(F.broadcast(count), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def ranked(df: DataFrame, column: str, key: str) -> DataFrame:
    """The column as its rank over n - 1; ties by key."""
    wide = with_totals(numbered(df, [F.col(column), F.col(key)], "_rank"), _n=F.count("*"))
    return wide.withColumn(column, F.col("_rank") / F.greatest(F.col("_n") - 1, F.lit(1))).select(*df.columns)


def fuse(df: DataFrame, fusion: str = "weighted_sum", weights: tuple[float, float, float] = (0.5, 0.5, 0.0), mode: str = "zscore", key: str = "i") -> DataFrame:
    """score_img, score_txt, score_joint in their normal form, and score_pair of the two or three."""
    df = df if "score_joint" in df.columns else df.withColumn("score_joint", F.lit(0.0))
    out = normalise(df, ["score_img", "score_txt", "score_joint"], mode, key)
    img, txt, joint = F.col("score_img"), F.col("score_txt"), F.col("score_joint")
    if fusion == "average":
        return out.withColumn("score_pair", (img + txt) / 2)
    if fusion == "max":
        return out.withColumn("score_pair", F.greatest(img, txt))
    if fusion == "geometric_mean":
        wide = with_totals(out, _i=F.min("score_img"), _t=F.min("score_txt"))
        return wide.withColumn("score_pair", F.sqrt((img - F.col("_i") + 1e-6) * (txt - F.col("_t") + 1e-6))).drop("_i", "_t")
    if fusion == "normalized_sum":
        return normalise(out.withColumn("score_pair", img + txt + joint), ["score_pair"], "minmax", key)
    if fusion == "weighted_sum":
        return out.withColumn("score_pair", weights[0] * img + weights[1] * txt + weights[2] * joint)
    raise ValueError(f"unknown fusion: {fusion}")


def top(df: DataFrame, score: str, k: int, key: str = "i", largest: bool = True) -> DataFrame:
    """The k rows of the best score, ties by key, with their rank from 1. k is the size of the subset wanted."""
    order = F.desc(score) if largest else F.asc(score)
    best = df.orderBy(order, key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col(key))))


def subset_size(n: int, ratio: float | None = None, budget: int | None = None) -> int:
    """Of n rows: a budget, or a ratio rounded half to even; at least 1, at most n."""
    if budget is None and ratio is None:
        raise ValueError("a budget or a ratio is needed")
    return max(1, min(n, budget if budget is not None else round(ratio * n)))


def shift_mix(key: Column, seed: int = 0) -> Column:
    """A repeatable pseudo-random number in [0, 2^31) of an integer key, stated in arithmetic that any engine has."""
    x = F.pmod(key * 1103515245 + F.lit(12345 + 7919 * seed), F.lit(2147483648))
    x = F.pmod(x * 69069 + F.lit(1), F.lit(2147483648))
    return F.pmod(F.floor(x / 65536) * 40503 + x, F.lit(2147483648))
