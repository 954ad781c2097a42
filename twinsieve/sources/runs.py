"""Runs on disk: summaries, metrics, logs and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"([+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"


def json_tree(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All files of a name below root, one row each, with file_path."""
    raw = spark.read.json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name)
    return raw.withColumn("file_path", F.col("_metadata.file_path"))


def from_path(c: Column, field: str) -> Column:
    """The digits after field_ in a path."""
    return F.regexp_extract(c, rf"{field}_(\d+)", 1).try_cast("int")


def baseline_runs(spark: SparkSession, root: str) -> DataFrame:
    """Summaries with the metrics beside them; seed and budget from the path where the file has none."""
    rows = json_tree(spark, root, "baseline_summary.json")
    for c in ("seed", "budget"):
        own = F.col(c).cast("int") if c in rows.columns else F.lit(None).cast("int")
        rows = rows.withColumn(c, F.coalesce(own, from_path(F.col("file_path"), c)))
    rows = rows.withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
    metrics = json_tree(spark, root, "downstream_metrics.json").withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", "")).drop("file_path")
    return rows.join(metrics.select("folder", *[c for c in metrics.columns if c not in rows.columns]), "folder", "left")


def table_line(lines: DataFrame, key: str, nth: str, text: str) -> DataFrame:
    """(key, values): of the lines with a bar and at least seven numbers the last that has one other than 0, else the last."""
    values = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))
    rows = lines.where(F.col(text).contains("|")).select(key, nth, values.alias("values")).where(F.size("values") >= 7)
    some = F.exists("values", lambda x: x != 0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(some.desc(), F.desc(nth)))
    return rows.withColumn("r", rank).where("r = 1").select(key, F.slice("values", 1, 7).alias("values"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, text) of log files."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("nth", "text"))


def flattened(df: DataFrame, key: str, column: str, depth: int = 6) -> DataFrame:
    """(key, path, value): every number in a column of JSON text, under the names that lead to it; booleans are none."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("v")).where("v is not null")
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        number = level.where(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(key, "path", F.try_variant_get("v", "$", "double").alias("value"))
        out = number if out is None else out.unionByName(number)
        inner = level.where(kind.rlike("^(OBJECT|ARRAY)")).select(key, "path", "v")
        inner.createOrReplaceTempView("_twinsieve_level")
        exploded = df.sparkSession.sql(f"select `{key}`, path, e.pos, e.key as name, e.value as v from _twinsieve_level, lateral variant_explode(v) as e")
        level = exploded.select(key, F.when(F.col("path") == "", F.coalesce("name", F.col("pos").cast("string"))).otherwise(F.concat_ws(".", "path", F.coalesce("name", F.col("pos").cast("string")))).alias("path"), "v")
    return out


def write_selection(selected: DataFrame, path: str, key: str = "i") -> None:
    """One JSON object {"selected_indices": [...]}, ascending. The list is the subset asked for."""
    selected.agg(F.array_sort(F.collect_list(F.col(key))).alias("selected_indices")).coalesce(1).write.mode("overwrite").json(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(i) of a selection file: an object with selected_indices, or a bare list."""
    raw = spark.read.text(path, wholetext=True)
    own = F.from_json("value", "selected_indices array<long>")["selected_indices"]
    return raw.select(F.explode(F.coalesce(own, F.from_json("value", "array<long>"))).alias("i"))


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as csv (empty for null, with header) or json."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).option("nullValue", "").csv(path) if kind == "csv" else out.json(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report as a Markdown table; one of more than `limit` rows is refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
