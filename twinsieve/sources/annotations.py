"""Annotation files as tables of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which records, captions and ids are found.
WRAPPERS = ("data", "annotations", "records", "examples", "samples")
CAPTIONS = ("caption", "text", "sentence", "description", "audio_caption")
IDS = ("youtube_id", "audio_id", "id", "file_name", "audio", "path")
#: Fixed value: marks that a caption loses.
MARKS = r"[.!\"()*#:;~]"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .csv (all strings), .jsonl, or .json file: a list, or a list under one of WRAPPERS."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if kind == "jsonl":
        return spark.read.json(path)
    if kind != "json":
        raise ValueError(f"unknown kind of file: {path}")
    raw = spark.read.json(path, multiLine=True)
    for name in WRAPPERS:
        if dict(raw.dtypes).get(name, "").startswith("array<struct"):
            return raw.select(F.inline(name))
    return raw


def first_present(df: DataFrame, names: tuple[str, ...], need: str | None = None) -> Column:
    """The first of the named columns that is not empty; `need`: what to fail with if none is."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    out = F.coalesce(*have) if have else F.lit(None).cast("string")
    return F.coalesce(out, F.raise_error(F.lit(need)).cast("string")) if need else out


def numbered(df: DataFrame) -> DataFrame:
    """df with sample_idx, its place in the file: from the ids of the scan, in order, without gaps."""
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    first = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    first = first.select("_part", "_low", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(first), "_part").withColumn("sample_idx", F.col("_before") + F.col("_at") - F.col("_low")).drop("_at", "_part", "_low", "_before")


def train_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, img_id, raw_image_id, image, caption): img_id counts images as they first come."""
    rows = numbered(records(spark, path))
    rows = rows.withColumn("raw_image_id", F.col("image_id").cast("string"))
    first = rows.groupBy("raw_image_id").agg(F.min("sample_idx").alias("at"))
    codes = first.select("raw_image_id", (F.row_number().over(Window.orderBy("at")) - 1).alias("img_id"))
    return rows.join(codes, "raw_image_id").select("sample_idx", "img_id", "raw_image_id", "image", normal_caption(F.col("caption"), 30).alias("caption"))


def eval_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images (img_id, image) and texts (txt_id, img_id, caption) of files with a list of captions an image."""
    rows = numbered(records(spark, path)).withColumnRenamed("sample_idx", "img_id")
    texts = rows.select("img_id", F.posexplode("caption").alias("nth", "caption"))
    before = rows.select("img_id", F.size("caption").alias("n"))
    before = before.select("img_id", (F.sum("n").over(Window.orderBy("img_id")) - F.col("n")).alias("before"))
    texts = texts.join(before, "img_id").select((F.col("before") + F.col("nth")).alias("txt_id"), "img_id", normal_caption(F.col("caption"), 30).alias("caption"))
    return rows.select("img_id", "image"), texts


def captioned(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(sample_idx, record_id, caption) of records whose fields have any of the known names."""
    rows = numbered(records(spark, path))
    out = rows.select("sample_idx", first_present(rows, IDS).alias("record_id"), first_present(rows, CAPTIONS, "a record has no caption").alias("caption"))
    return out.where(F.col("sample_idx") < most) if most is not None else out


def normal_caption(c: Column, words: int) -> Column:
    """Lower case, without MARKS, single spaces, at most `words` words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), MARKS, " "), r"\s{2,}", " ")
    return F.array_join(F.slice(F.split(F.trim(F.rtrim(plain)), " "), 1, words), " ")


def turns(conversations: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, prompt, answer): the first turn of a person, and the first answer after it; none without both."""
    person, model = F.lower(F.col(role)).isin("human", "user"), F.lower(F.col(role)).isin("gpt", "assistant")
    ask = conversations.where(person).groupBy(key).agg(F.min(order).alias("_at"), F.min_by(text, order).alias("prompt"))
    after = conversations.where(model).join(ask, key).where(F.col(order) > F.col("_at")).groupBy(key).agg(F.min_by(text, order).alias("answer"), F.first("prompt").alias("prompt"))
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("<image>"), F.lit("")))
    return after.select(key, clean("prompt").alias("prompt"), F.trim("answer").alias("answer"))


def file_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(key, path): files by name, stem, and stem without a leading Y; the least path wins."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    keys = F.array_distinct(F.array(name, stem, F.regexp_replace(stem, "^Y", "")))
    return files.select(F.explode(keys).alias("key"), F.col(path).alias("path")).groupBy("key").agg(F.min("path").alias("path"))


def resolve(rows: DataFrame, key: str, names: list[Column], index: DataFrame) -> DataFrame:
    """(key, path): the file of the first of the names that the index has."""
    tried = rows.select(key, F.posexplode(F.array(*names)).alias("nth", "key")).join(index, "key")
    return tried.groupBy(key).agg(F.min_by("path", "nth").alias("path"))


def safe_name(c: Column) -> Column:
    return F.translate(c, "\\/ ", "--_")
