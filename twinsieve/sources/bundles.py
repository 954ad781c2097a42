"""Bundles: several tables and a few facts in one folder, for features, graphs and selections.

A bundle is written to a folder of its own: one Parquet table for each name and, last, a
JSON file of facts. A folder without the facts is no bundle yet, so one that a lost job
left half written is built again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "facts"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a whole bundle is there."""
    p, files = _path(spark, f"{folder}/{FACTS}/_SUCCESS")
    return files.exists(p)


def write(folder: str, tables: dict[str, DataFrame], facts: dict) -> None:
    """All tables, then the facts. A bundle of the same folder is replaced."""
    spark = next(iter(tables.values())).sparkSession
    p, files = _path(spark, folder)
    files.delete(p, True)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/{FACTS}")


def read(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    if not exists(spark, folder):
        raise FileNotFoundError(f"no bundle in {folder}")
    facts = json.loads(spark.read.text(f"{folder}/{FACTS}").first()[0])
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, facts


def load_or_build(spark: SparkSession, folder: str, names: list[str], build: Callable[[], tuple[dict[str, DataFrame], dict]], overwrite: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """The bundle of a folder; it is built and written first if it is not there."""
    if overwrite or not exists(spark, folder):
        write(folder, *build())
    return read(spark, folder, names)


def write_features(folder: str, img: DataFrame, txt: DataFrame, meta: DataFrame, facts: dict) -> None:
    """Features (i, v) of both modalities and their rows; all three must have the same ids, each once."""
    for name, df in (("txt", txt), ("meta", meta)):
        left = img.select("i", F.lit(1).alias("n")).unionByName(df.select("i", F.lit(-1).alias("n")))
        odd = left.groupBy("i").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("n <> 0 or c <> 2").limit(1).collect()
        if odd:
            raise ValueError(f"{name} and img do not have the same ids: {odd[0]['i']}")
    write(folder, {"img": img, "txt": txt, "meta": meta}, facts | {"rows": img.count()})


def write_excel_csv(df: DataFrame, path: str) -> None:
    """A report as CSV that spreadsheets open: a byte order mark, the separator, a header, then the rows."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = "﻿sep=,\n" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = df.select(F.concat_ws(",", *map(cell, df.columns)).alias("value"), F.lit(1).alias("o"), F.monotonically_increasing_id().alias("k"))
    first = df.sparkSession.createDataFrame([(head, 0, 0)], "value string, o int, k long")
    first.unionByName(lines).orderBy("o", "k").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_all(tables: dict[str, DataFrame], folder: str) -> None:
    """Several reports, each as CSV and JSON in a folder of its name."""
    for name, df in tables.items():
        own = df.coalesce(1).write.mode("overwrite")
        own.option("header", True).option("nullValue", "").csv(f"{folder}/{name}.csv")
        own.json(f"{folder}/{name}.json")
