"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text's features are the buckets of its distinct lower-cased words, each with weight
1 / sqrt(number of buckets), and the numbers of STRUCTURE (log length and other metadata
that the text itself gives; labels, language, source and id are no inputs). The score is
the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

linear in the number of features. It is fitted with Adam on at most `sample` labelled
rows, never on held-out ones; scoring reads every text whole. Empty or null texts score
by their structure like others. Without labels of both kinds the score is constant: the
share of label 1, or 1 if there is no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, tune
from .samples import held_out, labelled
from .text_features import STRUCTURE, Batch, buckets

BITS = 17
FACTORS = 8
#: Labelled rows to fit on, at most.
SAMPLE = 6000
THRESHOLD = 0.7


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, row: np.ndarray, idx: np.ndarray, structure: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores before the logistic function, and what the gradient needs."""
        n = len(structure)
        count = np.bincount(row, minlength=n)
        x = (1 / np.sqrt(np.maximum(count, 1)))[row].astype(np.float32)
        z = np.clip((structure - self.mean) / self.scale, -4, 4).astype(np.float32)
        words = len(self.w) - len(STRUCTURE)
        linear = self.w0 + z @ self.w[words:]
        total = z @ self.v[words:]
        square = (z**2) @ (self.v[words:] ** 2)
        full = np.flatnonzero(count)
        if len(full):
            first = np.searchsorted(row, full)
            vx = self.v[idx] * x[:, None]
            linear[full] += np.add.reduceat(self.w[idx] * x, first)
            total[full] += np.add.reduceat(vx, first, axis=0)
            square[full] += np.add.reduceat(vx**2, first, axis=0)
        return linear + 0.5 * (total**2 - square).sum(axis=1), x, z, total

    def scores(self, col: pa.Array) -> np.ndarray:
        batch = Batch(col, lower=True)
        row, idx = buckets(batch.hashes, batch.word_row, BITS)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, idx, batch.structure())[0], -30, 30)))


def features(batch: pa.RecordBatch) -> pa.RecordBatch:
    own = Batch(batch.column(1), lower=True)
    row, idx = buckets(own.hashes, own.word_row, BITS)
    cut = np.searchsorted(row, np.arange(own.rows + 1))
    structure = own.structure()
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2).cast(pa.int32()), pa.array([idx[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32())), pa.array(list(structure), pa.list_(pa.float64()))],
        names=["id", "y", "idx", "structure"],
    )


def constant(share: float) -> Machine:
    words = (1 << BITS) + len(STRUCTURE)
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Machine(float(np.log(share / (1 - share))), np.zeros(words, np.float32), np.zeros((words, FACTORS), np.float32), np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))


def machine(got: pa.Table, epochs: int, seed: int) -> Machine:
    """Adam on the log loss over rows (id, y, idx, structure), with those of either label weighing alike."""
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    y = got.column("y").to_numpy()[order].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 1.0)
    lists = got.column("idx").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    idx = [values[offsets[k] : offsets[k + 1]] for k in order]
    structure = np.array(got.column("structure").to_pylist())[order]
    m = constant(0.5)
    m.mean, m.scale = structure.mean(axis=0), np.maximum(structure.std(axis=0), 1e-3)
    rng = np.random.default_rng(seed)
    m.v[:] = rng.normal(0, 0.02, m.v.shape)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    words = 1 << BITS
    first, second = [np.zeros_like(p) for p in (m.w, m.v)], [np.zeros_like(p) for p in (m.w, m.v)]
    bias, step, rate, decay = np.zeros(2), 0, 0.02, 1e-4
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            step += 1
            row = np.repeat(np.arange(len(part)), [len(idx[k]) for k in part])
            own = np.concatenate([idx[k] for k in part]) if len(row) else np.zeros(0, np.int32)
            raw, x, z, total = m.raw(row, own, structure[part])
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32)
            used, at = np.unique(own, return_inverse=True)
            gw = np.zeros(len(used) + len(STRUCTURE), np.float32)
            gv = np.zeros((len(gw), FACTORS), np.float32)
            gx = g[row] * x
            gw[: len(used)] = np.bincount(at, gx, minlength=len(used))
            for f in range(FACTORS):
                gv[: len(used), f] = np.bincount(at, gx * (total[row, f] - m.v[own, f] * x), minlength=len(used))
            gw[len(used) :] = z.T @ g
            gv[len(used) :] = z.T @ (g[:, None] * total) - (z**2).T @ g[:, None] * m.v[words:]
            rows = np.concatenate([used, words + np.arange(len(STRUCTURE))])
            for p, grad, a, b in ((m.w, gw, first[0], second[0]), (m.v, gv, first[1], second[1])):
                grad = grad + decay * p[rows]
                a[rows] = 0.9 * a[rows] + 0.1 * grad
                b[rows] = 0.999 * b[rows] + 0.001 * grad**2
                p[rows] -= rate * (a[rows] / (1 - 0.9**step)) / (np.sqrt(b[rows] / (1 - 0.999**step)) + 1e-8)
            bias[0] = 0.9 * bias[0] + 0.1 * g.sum()
            bias[1] = 0.999 * bias[1] + 0.001 * g.sum() ** 2
            m.w0 -= rate * (bias[0] / (1 - 0.9**step)) / (np.sqrt(bias[1] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE, epochs: int = 8, seed: int = 1) -> Machine:
    """The machine of a bounded sample, fitted by one task, so that its rows never come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            m = machine(pa.Table.from_batches(held), epochs, seed)
            parts = {"w": m.w, "v": m.v, "mean": m.mean, "scale": m.scale}
            yield pa.RecordBatch.from_arrays([pa.array([float(m.w0)]), *(pa.array([x.tobytes()], pa.binary()) for x in parts.values())], names=["w0", *parts])

    rows = labelled(docs, labels, id_col, text_col, label, sample).select("id", "text", "y").mapInArrow(per_batch(features), f"id {dict(docs.dtypes)[id_col]}, y int, idx array<int>, structure array<double>")
    got = rows.repartition(1).mapInArrow(run, "w0 double, w binary, v binary, mean binary, scale binary").first()
    if got is None:
        return constant(1.0)
    w, v = np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32)
    return Machine(got["w0"], w, v.reshape(-1, FACTORS), np.frombuffer(got["mean"]), np.frombuffer(got["scale"]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs -> (id_col, held_out, score, predicted), a row for each row of docs."""
    spark = tune(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample=sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.value.scores(batch.column(1)).astype(np.float64))], names=[id_col, "held_out", "score"])

    scored = docs.select(F.col(id_col), F.col(text_col), held_out(id_col)).mapInArrow(per_batch(run), f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    spark = tune(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.value.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(per_batch(run), docs.schema)
