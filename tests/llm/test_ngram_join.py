import random
import re

import pytest

from twinsieve.llm.ngram_join import near_duplicates


def sets_of(text):
    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    own = {i: sets_of(t) for i, t in rows if i is not None}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(own[i]), find(i)) for i in own}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not bases:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 30, 80, 200])))
            bases.append(text)
        elif kind < 0.6:
            text = rng.choice(bases)
        elif kind < 0.7:
            text = passage + "\n" + " ".join(rng.choices(vocabulary, k=20))
        else:
            words = rng.choice(bases).split()
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            text = rng.choice([" ", "\t", "\n"]).join(words)
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t ")]


@pytest.mark.parametrize("cell", [2048, 3])
def test_against_all_pairs(spark, cell):
    rows = corpus(cell, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, cell=cell).collect()}
    assert got == brute(rows)


def test_large_group_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"a{k}" for k in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "z"))
    rows += [(1000, "b " * 5000 + "end", "c"), (1000, "b " * 5000 + "end", "c"), (None, " ".join(base), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = near_duplicates(docs).collect()
    assert len(got) == 403
    want = brute([(i, t) for i, t, _ in rows[:401]])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []


def test_long_words_and_lines_with_swapped_halves():
    import pyarrow as pa

    from twinsieve.llm.ngram_join import shingle_sets
    from twinsieve.llm.text_features import Batch

    a, b = "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096
    x, y, z = (s.tolist() for s in shingle_sets(pa.array([a, b, a])))
    assert x != y and x == z
    long = ("a " * 32768 + "b " * 32768).strip()
    swapped = ("b " * 32768 + "a " * 32768).strip()
    assert Batch(pa.array([long + "\n" + swapped, long + "\n" + long])).dup_lines().tolist() == [0, 1]
