"""Best-fit packing planned on a histogram of lengths.

Each text becomes its ids and an end id. Longer ones are cut into pieces of `capacity`
tokens; nothing else is cut. Pieces are counted by length; the driver plans best-fit
decreasing on the counts alone (at most `capacity` numbers), which gives runs of slots:
the pieces of one length, from one rank to another, into that many sequences. Each piece
then takes the slot of its rank within its length. Ranks are formed in chunks, so a
length that a third of all pieces share is ranked by many tasks.

Null text counts as empty and packs as the end id alone. Repeated rows are packed as
often as they come. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune
from .word_ids import word_ids

CAPACITY = 4096
END_ID = 1
#: Pieces that one task ranks, on average.
CHUNK = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, own in enumerate(encode.batch(batch.column(1).to_pylist())):
                ids = memoryview(own + end)
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    rows.append(k)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, pieces a sequence, first sequence, offset).

    Sequences with the same room are kept as ranges of their numbers. The longest pieces
    come first; each goes where the least room is left that still holds it, or else into a
    new sequence. A sequence that takes one piece of a length takes as many as fit, as it
    is then the tightest.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                bisect.insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[k]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, whole * each, each, first, capacity - room))
                leave(room - each * length, first, whole)
                left -= whole * each
                rank += whole * each
            if whole < n and left:
                runs.append((length, rank, left, left, first + whole, capacity - room))
                leave(room - left * length, first + whole, 1)
                rank += left
                left, whole = 0, whole + 1
            leave(room, first + whole, n - whole)
    return runs


def place(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = table[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(own[:, 4] + nth // own[:, 3]), pa.array(own[:, 5] + nth % own[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, chunk: int = CHUNK) -> DataFrame:
    """docs -> a row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    pieces = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut(tokenizer, capacity, end_id), PIECES))
    counts = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}
    chunks = -(-sum(counts.values()) // chunk) + 15
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = pieces.groupBy("length", "chunk").agg(F.count("*").alias("c"))
    before = before.select("length", "chunk", (F.sum("c").over(Window.partitionBy("length").orderBy("chunk")) - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = pieces.withColumn("nth", nth).join(before, ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).cast("long").alias("rank"))
    return ranked.mapInArrow(place(plan(counts, capacity)), PIECES + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
