"""Token counts of flat token files by a separator scan.

A token file is a run of ids of fixed width, each document followed by the
end-of-document id, without any index. It is read in blocks that end anywhere. Every
block is searched for the separator with one vectorised comparison; what a block knows
by itself (its tokens, its separators, where the first and the last stand) is one small
row. A prefix scan over these rows, within groups of blocks and then over the groups,
tells each block how many documents ended before it and where its first one began.

Tokens after the last separator of a file form a last, unterminated document. Two
separators in a row hold an empty one. A file without tokens gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, tune
from .word_ids import word_ids

#: Tokens in a block.
BLOCK = 1 << 16
#: Blocks in a group of the prefix scan.
GROUP = 1 << 12


def write_stream(path: str, eod: int, block: int = BLOCK):
    """Texts of a partition -> the blocks of its file (u16 ids), beside the order of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, plain=True)  # the separator must not come from a text
        file = TaskContext.get().partitionId()
        names = ["file", "block", "payload", "nth", "doc_id"]
        held, n_block, nth = bytearray(), 0, 0
        end = int(eod).to_bytes(2, "little")

        def full(least: int) -> pa.RecordBatch | None:
            nonlocal n_block
            size, out = 2 * block, []
            while len(held) >= least and held:
                out.append(bytes(held[:size]))
                del held[:size]
            m = len(out)
            n_block += m
            return pa.RecordBatch.from_arrays([pa.array([file] * m, pa.int32()), pa.array(range(n_block - m, n_block), pa.int64()), pa.array(out, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names) if m else None

        for batch in batches:
            for own in encode.batch(batch.column(1).to_pylist()):
                ids = np.frombuffer(own, "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id does not fit in two bytes")
                held += ids.astype("<u2").tobytes() + end
                if len(held) > 64 * block and (got := full(2 * block)):
                    yield got
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(nth, nth + m), pa.int64()), batch.column(0)], names=names)
            nth += m
            if got := full(2 * block):
                yield got
        if got := full(1):
            yield got

    return run


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK, together: int = 64) -> DataFrame:
    """Raw token files below path -> (file string, block, payload), whatever their size.

    The files are listed with their sizes; each task seeks to ranges of `together` blocks and
    holds one block at a time. A file's size must be a multiple of width. The path must be
    one that pyarrow opens on the executors (a shared folder, HDFS, S3, GCS).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole number of ids")
                files, inside = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with files.open_input_file(inside) as f:
                    f.seek(first * width * block)
                    for k in range(first, min(first + together, -(-size // (width * block)))):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([f.read(width * block)], pa.binary())], names=["file", "block", "payload"])

    files = tune(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (width * block)), F.lit(together).cast("long"))).alias("first"), "length")
    return ranges.repartition("path", "first").mapInArrow(cut, "file string, block long, payload binary")


def search(eod: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, last, inner, begins = [], [], [], [], []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), dtype=kind)
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
                begins.append(at[:-1] + 1)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(begins, pa.list_(pa.int64()))], names=["file", "block", "n", "first", "last", "inner", "begins"])

    return run


def count_tokens(blocks: DataFrame, scratch: Scratch, eod: int, width: int = 2, group: int = GROUP) -> DataFrame:
    """blocks(file, block, payload) -> (file, nth, start, n_tokens, terminated), a row for each document."""
    kind = dict(blocks.dtypes)["file"]
    rows = blocks.select("file", "block", "payload").mapInArrow(search(eod, width), f"file {kind}, block long, n long, first long, last long, inner array<long>, begins array<long>")
    rows = scratch.write(rows.withColumn("docs", F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)).withColumn("group", F.floor(F.col("block") / group)))
    within = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.withColumn("n0", zero(F.sum("n").over(within))).withColumn("d0", zero(F.sum("docs").over(within)))
    rows = rows.withColumn("s0", F.max(F.col("n0") + F.col("last") + 1).over(within))
    total = rows.groupBy("file", "group").agg(F.sum("n").alias("gn"), F.sum("docs").alias("gd"), F.max(F.col("n0") + F.col("last") + 1).alias("gs"))
    total = total.withColumn("g_n0", zero(F.sum("gn").over(over))).withColumn("g_d0", zero(F.sum("gd").over(over)))
    total = total.withColumn("g_s0", zero(F.max(F.col("g_n0") + F.col("gs")).over(over))).withColumn("whole", F.sum("gn").over(Window.partitionBy("file")))
    rows = rows.join(total.select("file", "group", "g_n0", "g_d0", "g_s0", "whole"), ["file", "group"])
    rows = rows.select("file", "first", "last", "inner", "begins", "n", "whole", (F.col("g_n0") + F.col("n0")).alias("at"), (F.col("g_d0") + F.col("d0")).alias("nth0"), F.coalesce(F.col("g_n0") + F.col("s0"), F.col("g_s0")).alias("begin"))
    lengths = F.concat(F.array(F.col("at") + F.col("first") - F.col("begin")), "inner")
    starts = F.concat(F.array("begin"), F.transform("begins", lambda x: x + F.col("at")))
    ended = rows.where("first is not null").select("file", "nth0", F.posexplode(F.arrays_zip(lengths.alias("n_tokens"), starts.alias("start"))).alias("k", "d"))
    ended = ended.select("file", (F.col("nth0") + F.col("k")).alias("nth"), "d.start", "d.n_tokens", F.lit(True).alias("terminated"))
    tail = rows.where("at + n = whole and n > 0").select("file", (F.col("nth0") + F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)).alias("nth"), F.coalesce(F.col("at") + F.col("last") + 1, F.col("begin")).alias("start"), "whole")
    tail = tail.where("start < whole").select("file", "nth", "start", (F.col("whole") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(tail)


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """docs -> (id_col, file, nth, start, n_tokens): written as flat token files, one for each partition, and counted by the scan.

    Null text counts as empty: 0 tokens. Repeated rows are counted each.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    stream = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stream = scratch.write(stream.mapInArrow(write_stream(tokenizer, eod, block), "file int, block long, payload binary, nth long, doc_id long"))
    counted = count_tokens(stream.where("block is not null"), scratch, eod, 2, group)
    order = stream.where("block is null").select("file", "nth", "doc_id")
    return order.join(counted, ["file", "nth"]).select(F.col("doc_id").alias(id_col), "file", "nth", "start", "n_tokens")
