"""Term weights of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf(docs: DataFrame, key: str, text: str, most: int, pattern: str = r"\p{L}{3,}", stop: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """(key, term, weight): counts times ln((1 + n) / (1 + df)) + 1, each text's row of length 1.

    Terms are matches of the pattern in lower case, and runs of two if pairs; the `most`
    terms that come most often are kept, ties in order of the term.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1)), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    terms = docs.select(F.col(key), words.alias("w"))
    if pairs:
        two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
        terms = terms.withColumn("w", F.concat("w", two))
    n = terms.where(F.size("w") > 0).agg(F.count_distinct(key).alias("n"))
    tf = terms.select(key, F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    kept = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    x = tf.join(F.broadcast(kept), "term").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return x.select(key, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("weight"))
