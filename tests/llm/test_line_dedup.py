import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from twinsieve.llm.line_dedup import close, dedup_lines, keep, probes


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@functools.lru_cache(maxsize=None)
def words_of(line):
    own = re.split(r"[ \t\r]+", line)
    return own, frozenset(own)


def is_near(a, b):
    (u, x), (v, y) = words_of(a), words_of(b)
    if len(u) >= 8 and len(v) >= 8:
        n = min(len(u), len(v))
        most = 1 if n < 18 else 2 if n < 32 else 3
        return abs(len(u) - len(v)) <= most and len(x ^ y) <= 2 * most and edits(u, v) <= most
    return len(u) < 8 and len(v) < 8 and min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1


def brute(rows):
    place = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            n = line.strip(" \t\r").lower()
            if len(n) >= 24 or re.search(r"[^\W_]", n):
                place.setdefault(n, (i, p))
    near = {y for y in place for x in place if place[x] < place[y] and is_near(x, y)}
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        left = []
        for p, line in enumerate(t.split("\n")):
            n = line.strip(" \t\r").lower()
            if n not in place or (place[n] == (i, p) and n not in near):
                left.append(line)
        out.append((i, "\n".join(left)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(40)]
    known = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 5, 6, 7, 8, 9, 12, 17, 18, 19, 25, 31, 32, 33, 40, 60) for _ in range(2)]
    known += ["".join(rng.choices("abcdé", k=k)) for k in (3, 23, 24, 25, 40)] + ["ab " * 30]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(known).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                k = rng.randrange(len(line))
                line[k : k + 1] = rng.choice([[], [rng.choice(words)], [line[k], rng.choice(words)], [line[k][:-1] + "z"]])
                line = line or ["q"]
            lines.append(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice([" ", "  "]).join(line)) + rng.choice(["", "\r", " "]))
        rows.append((i, "\n".join(lines)))
    return rows + [(80, None), (81, ""), (82, "\n\n--\n--"), (None, rows[3][1]), (83, "long " * 4000 + "\n" + "long " * 4000), (1, rows[1][1])]


@pytest.mark.parametrize(("seed", "small"), [(1, 1_000_000), (2, 0)])
def test_against_all_pairs(spark, seed, small):
    """Also with no table small enough to be broadcast, and with columns named like those the operator uses."""
    rows = corpus(seed)
    names = ["key", "pos", "gone", "_id", "_page", "_in", "line", "row", "all", "left", "_lines"]
    docs = spark.createDataFrame([(*r, *["k"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = dedup_lines(docs, small=small).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=order) == sorted(brute(rows), key=order)
    assert all(r[n] == "k" for r in got for n in names[:-1])
    for r in got:
        assert r._lines - r._removed == (0 if r.text is None else r.text.count("\n") + 1) or (r.text == "" and r._lines == r._removed)


def test_many_near_copies_of_a_line(spark):
    """A large group under one key goes but for its first line, and so do those that only a later line is near to."""
    words = [f"w{k}" for k in range(20)]
    lines = [" ".join([*words[:k], f"x{m}", *words[k + 1 :]]) for m in range(15) for k in range(20)]
    far = " ".join(words[:10] + [f"y{k}" for k in range(10)])
    rows = [(0, far), *[(k + 1, t) for k, t in enumerate(lines)]]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, t in got.items() if t] == [0, 1]


def test_automaton(spark):
    rng = random.Random(9)
    rows = [("", ""), ("", "a"), ("ab", "ba"), ("abc", "c"), ("aab", "ab")]
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        rows.append((a, "".join(rng.choices("ab", k=rng.randint(0, 12)))))
    df = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(rows)], "i int, x array<string>, y array<string>")
    for most in (1, 2, 3):
        got = {r.i for r in df.where(close(F.col("x"), F.col("y"), F.lit(most))).collect()}
        assert got == {i for i, (a, b) in enumerate(rows) if edits(a, b) <= most}


def runs_of(line, by_word):
    """Keys of a line, by plain slices: (key, filed)."""
    n = len(line)
    for t, i, move, size, step, filed in probes(min(n, 35 // 16 * 16 + 16 + n % 16) if by_word and n >= 35 else n if by_word else 0, by_word):
        size = size or ((n // 16 - step) * 4 if by_word else (n - step) // 2)
        start = (i * size if 2 * i <= t else n - (t + 1 - i) * size) + move
        assert size > 0 and start >= 0 and start + size <= n
        yield (t, i, size if by_word else n - step, tuple(line[start : start + size])), filed


@pytest.mark.parametrize("by_word", [True, False])
def test_lines_within_the_threshold_share_a_filed_key(by_word):
    rng = random.Random(11)
    for n in [*range(8, 120), 500] if by_word else range(24, 80):
        for _ in range(60):
            short = [rng.randrange(3) for _ in range(n)]
            most = 1 if not by_word or n < 18 else 2 if n < 32 else 3
            long = list(short)
            for _ in range(most):
                at, kind = rng.randrange(len(long) + 1), rng.randrange(3)
                if kind == 0:
                    long.insert(at, rng.randrange(9))
                elif kind == 1 and at < len(long):
                    long[at] = rng.randrange(9)
                elif at < len(long) and len(long) > n:
                    del long[at]
            filed = {key for key, own in runs_of(short, by_word) if own}
            assert filed & {key for key, _ in runs_of(long, by_word)}


def test_a_line_has_few_keys():
    assert [len(probes(n, True)) for n in (8, 17, 20, 31, 35)] == [2, 2, 5, 5, 8]
    assert len(probes(0, False)) == 4


def test_keep_and_native_plan(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough to count\nfree"), (2, "A line that is long enough to count"), (3, ""), (4, "short")], "doc_id long, text string")
    kept = keep(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a line that is long enough to count\nfree"), (3, ""), (4, "short")]
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert dedup_lines(docs.where(F.lit(False))).collect() == []


def test_short_lines(spark):
    docs = spark.createDataFrame([(1, "les.\nA line that is long enough to count\n--\n\n"), (2, "Les. \na line that is long enough to count!\n--\n\nlex."), (3, "a line that is long enough to count\nles."), (4, "les.\nles.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == {1: "les.\nA line that is long enough to count\n--\n\n", 2: "--\n\nlex.", 3: "", 4: ""}
    assert sorted(r.doc_id for r in keep(docs).collect()) == [1, 2]
