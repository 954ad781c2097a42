"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) has this remainder by 4 are held out from every fit.
HELD_OUT = 2


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, limit: int) -> DataFrame:
    """At most `limit` rows (id, text, y) with a label and not held out: those of the least hash of the id.

    Ids that carry different labels take the least, and of several rows of an id one is taken; rows without a label or an id are left out.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(limit)
    # the side that is broadcast has at most `limit` rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    # an id that comes with several rows is fitted on once, so that the sample is bounded whatever repeats
    return rows.groupBy("id").agg(F.min(F.struct("text", "y")).alias("row")).select("id", "row.text", "row.y")
