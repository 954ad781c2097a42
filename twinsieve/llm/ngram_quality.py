"""Quality rules: base rules, then a calibrated logistic regression on hashed n-grams.

Words are runs of bytes without white space. The base rules reject texts of under 50
words and texts of which more than half the words stand in windows of three words that
come twice or more. What passes is judged by a logistic regression over hashed words,
hashed pairs of words and hashed runs of four characters (code points); each text's feature
is the share of its words, pairs or runs that fall in a bucket. It is fitted on at most `sample` labelled rows; a further share of them,
not used in the fit, calibrates the probability (a slope and an offset, by Newton steps).
The verdict holds the probability against a fixed threshold. Counts are taken over whole
texts; words and windows are compared by 64-bit hashes.

Null text counts as empty, so it fails the base rules. Without labels of both kinds, all
that pass the base rules are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, per_batch, tune
from .samples import labelled
from .text_features import Batch

WORD_BITS = 16
CHAR_BITS = 16
#: Characters in a run.
CHARS = 4
SAMPLE = 5000
THRESHOLD = 0.5
MIN_WORDS = 50


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first byte of every character, and a number for the character: its bytes, at most four."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    value = padded[lead].astype(np.uint32)
    size = np.diff(np.append(lead, len(data)))
    for k in range(1, 4):
        value = np.where(size > k, value << np.uint32(8) | padded[lead + k], value)
    return lead, value


def hashed(batch: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs of words and runs of CHARS characters: their buckets and rows, in order of rows."""
    h, row = batch.hashes, batch.word_row
    out = [((h >> np.uint64(64 - WORD_BITS)).astype(np.int32), row)]
    same = np.flatnonzero(row[1:] == row[:-1])
    two = mix(h[same] * np.uint64(0x9E3779B97F4A7C15) + h[same + 1])
    out.append(((two >> np.uint64(64 - WORD_BITS)).astype(np.int32) + (1 << WORD_BITS), row[same]))
    lead, value = code_points(batch.data)
    of = np.searchsorted(batch.offsets, lead, side="right") - 1
    m = max(len(lead) - CHARS + 1, 0)
    own = np.flatnonzero(of[:m] == of[len(of) - m :])
    total = np.zeros(len(own), np.uint32)
    for k in range(CHARS):
        total = total * np.uint32(0x01000193) + (value[own + k] + np.uint32(k + 1)) * np.uint32(2654435769)
    bucket = (total ^ total >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - CHAR_BITS)
    out.append((bucket.astype(np.int32) + (2 << WORD_BITS), of[own]))
    return out


@dataclass
class Regression:
    bias: float
    w: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, batch: Batch) -> np.ndarray:
        out = np.full(batch.rows, self.bias)
        for idx, row in hashed(batch):
            total = np.bincount(row, self.w[idx], minlength=batch.rows)
            out += total / np.maximum(np.bincount(row, minlength=batch.rows), 1)
        return out

    def probability(self, batch: Batch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(batch) + self.offset, -30, 30)))


def features(batch: pa.RecordBatch) -> pa.RecordBatch:
    own = Batch(batch.column(1), lower=True)
    families = [(idx, np.searchsorted(row, np.arange(own.rows + 1))) for idx, row in hashed(own)]
    rows_idx, rows_val = [], []
    for k in range(own.rows):
        counts = [np.unique(idx[cut[k] : cut[k + 1]], return_counts=True) for idx, cut in families]
        rows_idx.append(np.concatenate([i for i, _ in counts]).astype(np.int32))
        rows_val.append(np.concatenate([c / max(c.sum(), 1) for _, c in counts]).astype(np.float32))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(rows_idx, pa.list_(pa.int32())), pa.array(rows_val, pa.list_(pa.float32()))], names=["id", "y", "idx", "val"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE, epochs: int = 12, seed: int = 1) -> Regression | None:
    """Adagrad on the log loss over four of five sampled rows; the fifth calibrates. None without both labels."""
    got = labelled(docs, labels, id_col, text_col, label, sample).select("id", "text", "y").mapInArrow(per_batch(features), "id long, y int, idx array<int>, val array<float>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    y = got.column("y").to_numpy()[order].astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    idx_list, val_list = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    flat_i, flat_v, offsets = idx_list.values.to_numpy(), val_list.values.to_numpy(), idx_list.offsets.to_numpy()
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(y))
    train, rest = shuffled[len(y) // 5 :], shuffled[: len(y) // 5]
    m = Regression(0.0, np.zeros((2 << WORD_BITS) + (1 << CHAR_BITS)))

    def rows(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [slice(offsets[order[k]], offsets[order[k] + 1]) for k in part]
        row = np.repeat(np.arange(len(part)), [s.stop - s.start for s in own])
        return row, np.concatenate([flat_i[s] for s in own]), np.concatenate([flat_v[s] for s in own])

    share = y[train].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    seen, seen_bias = np.full(len(m.w), 1e-8), 1e-8
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            row, i, v = rows(part)
            raw = m.bias + np.bincount(row, m.w[i] * v, minlength=len(part))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)
            used, at = np.unique(i, return_inverse=True)
            grad = np.bincount(at, g[row] * v, minlength=len(used)) + 1e-7 * m.w[used]
            seen[used] += grad**2
            m.w[used] -= 0.3 * grad / np.sqrt(seen[used])
            seen_bias += g.sum() ** 2
            m.bias -= 0.1 * g.sum() / np.sqrt(seen_bias)
    if len(rest) > 20 and y[rest].min() < y[rest].max():
        row, i, v = rows(rest)
        raw, target = m.bias + np.bincount(row, m.w[i] * v, minlength=len(rest)), y[rest]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            s = p * (1 - p)
            grad = np.array([((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
            move = np.linalg.solve(hess, grad)
            move *= min(1, 2 / np.abs(move).max())
            a, b = a - move[0], b - move[1]
        if a > 0:
            m.slope, m.offset = float(a), float(b)
    return m


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs -> the base counts, base_failed, probability and kept, a row for each row of docs."""
    spark = tune(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample=sample))
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Batch(batch.column(1))
        counts = [own.n_words, own.word_chars(), own.n_symbols(), own.dup_lines(), own.repeat_words()]
        failed = (own.n_words < MIN_WORDS) | (100 * counts[4] > 50 * own.n_words)
        p = model.value.probability(Batch(batch.column(1), lower=True)) if model.value else np.ones(own.rows)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=names)

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(id_col, F.col(text_col)).mapInArrow(per_batch(run), schema)
