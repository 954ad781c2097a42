"""Choosing rows by a selection, and the checks that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_positions(rows: DataFrame, chosen: DataFrame, key: str = "i", order: str = "rank") -> DataFrame:
    """The rows that chosen(key, order) names, with their place in the list; one named twice comes twice."""
    return rows.join(chosen.select(key, order), key)


def in_random_order(rows: DataFrame, chosen: DataFrame, seed: int, key: str = "i") -> DataFrame:
    """Chosen rows with a repeatable random number to sort by."""
    return rows.join(chosen.select(key), key).withColumn("shuffle", F.xxhash64(F.lit(seed), key))


def faults(rows: DataFrame, chosen: DataFrame, key: str = "i") -> DataFrame:
    """(key, fault): what a selection names twice, and what it names that is no row."""
    twice = chosen.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("twice").alias("fault"))
    return twice.unionByName(chosen.select(key).distinct().join(rows.select(key), key, "left_anti").select(key, F.lit("unknown").alias("fault")))


def validated(rows: DataFrame, chosen: DataFrame, key: str = "i") -> DataFrame:
    """The chosen rows; a selection with a fault is refused."""
    found = [f"{r[key]} ({r['fault']})" for r in faults(rows, chosen, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError("not a selection of these rows: " + ", ".join(found))
    return rows.join(chosen.select(key), key, "left_semi")


def pool(rows: DataFrame, k: int, key: str = "i", seed: int | None = None) -> DataFrame:
    """k rows to choose from: those of the least keys, or of the least hash of seed and key."""
    by = [F.col(key)] if seed is None else [F.xxhash64(F.lit(seed), key), F.col(key)]
    return rows.orderBy(*by).limit(k)


def records(rows: DataFrame, mode: str, chosen: DataFrame | None = None, percent: float = 100.0, seed: int = 0, key: str = "i") -> DataFrame:
    """All records ("full"), those of a selection ("ours", unknown ones left out), or a percentage by hash ("random")."""
    if mode == "full":
        return rows
    if mode == "ours":
        return rows.join(chosen.select(key).distinct(), key, "left_semi")
    if mode != "random":
        raise ValueError(f"unknown mode: {mode}")
    return pool(rows, max(1, round(rows.count() * percent / 100)), key, seed)


def proxy_meta(matched: DataFrame, meta: DataFrame) -> DataFrame:
    """match(p, i) with the row of each sample, under the proxy's own number."""
    return matched.select("p", "i").join(meta, "i")


def size_tag(size: Column) -> Column:
    return F.format_string("size_%04d", size.cast("int"))


def ratio_tag(ratio: Column) -> Column:
    """Per cent, a half to the even one."""
    return F.format_string("ratio_%02d", F.bround(ratio * 100).cast("int"))


def prompt_and_answer(prompt: Column, answer: Column) -> Column:
    return F.trim(F.concat_ws("\n", prompt, answer))


def alignment(a: DataFrame, b: DataFrame, key: str = "i") -> DataFrame:
    """One row: keys of both sides, of the left alone and of the right alone."""
    both = a.select(key, F.lit(1).alias("a")).join(b.select(key, F.lit(1).alias("b")), key, "full")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), count(F.col("b").isNull()).alias("left_only"), count(F.col("a").isNull()).alias("right_only"))


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for a key: that of the least order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def paired_shuffle(rows: DataFrame, a: str, b: str, seed: int) -> DataFrame:
    """Two arrays of a row in one and the same random order."""
    both = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x, k: F.struct(F.xxhash64(F.lit(seed), k).alias("h"), k.alias("k"), x["a"].alias("a"), x["b"].alias("b")))
    both = F.array_sort(both)
    return rows.withColumns({a: F.transform(both, lambda x: x["a"]), b: F.transform(both, lambda x: x["b"])})
