import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import fm_quality, ngram_quality

ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n x\nx", "#*$ %&| <>", "é ü ß\x1fz 日本", "a\r\na\r\nb", "w " * 60, "A b c d " * 30, "\n \n \n", "last\n\nlast\n"]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = rng.choices(["alpha", "beta", "gamma", "delta", "eps"] + [f"v{k}" for k in range(300)], k=rng.randint(60, 150))
        text = " ".join(words) + ".\n" + " ".join(words[:9]) if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(1200, 4)
    rows += [(5000 + k, t) for k, t in enumerate(ODD)] + [(7, rows[7][1]), (None, "null id")]
    docs = spark.createDataFrame([(*r, 0.1, "en") for r in rows], "doc_id long, text string, score double, lang string")
    return rows, dict((i, q) for i, q, _ in labels), docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_base_counts(tables):
    rows, _, docs, labels = tables
    got = ngram_quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        own = base(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, want[r.doc_id]
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.base_failed and r.kept)


def test_kept_agrees_with_labels(tables):
    _, quality, docs, labels = tables
    got = [r for r in ngram_quality.judge(docs, labels).collect() if r.doc_id in quality and not r.base_failed]
    assert np.mean([r.kept == bool(quality[r.doc_id]) for r in got]) > 0.97


def test_factorisation_machine(tables):
    rows, quality, docs, labels = tables
    got = fm_quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 100
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = fm_quality.constant(0.5)
    m.w[:], m.v[:] = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    row, idx, structure = np.array([0, 0, 0, 2]), np.array([3, 9, 11, 3]), rng.normal(size=(3, len(fm_quality.STRUCTURE)))
    got = m.raw(row, idx, structure)[0]
    words = 1 << fm_quality.BITS
    for k in range(3):
        own = idx[row == k]
        x = {int(i): 1 / np.sqrt(len(own)) for i in own} | {words + j: np.clip(v, -4, 4) for j, v in enumerate(structure[k])}
        want = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(x[i] * x[j] * float(m.v[i] @ m.v[j]) for i in x for j in x if i < j)
        assert abs(got[k] - want) < 1e-3 * max(1, abs(want))


def test_without_labels(spark, tables):
    docs = tables[2]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in fm_quality.score(docs, none).collect()} == {1}
    assert all(r.kept != r.base_failed for r in ngram_quality.judge(docs, none).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fm_quality.score(empty, none).collect() == [] and ngram_quality.judge(empty, none).collect() == []
