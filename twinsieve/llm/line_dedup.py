"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line is a piece of a text between line feeds; lines are compared in lower case without
the spaces, tabs and carriage returns at their ends. Lines without a letter or digit and of
fewer than `min_chars` characters are left alone. A line goes if a line before it, in order
of (id, position), equals it or is within the threshold of edits. The rest of the text
stays as it is.

Edits count words where both lines have `MIN_WORDS` or more: one edit, two from `TWO` words
of the shorter line on and three from `THREE` words on, so that a changed word is one edit
whatever its length. Lines of fewer words and at least `min_chars` characters are compared
by characters, with one edit. Shorter lines go only as exact repeats.

The join (Li et al., Pass-Join, 2011): equal lines are first made one class, whose first
line stands for it. A line of n symbols is split into threshold + 1 segments; two lines within
the threshold share one of them, and so the run at its outer end. Runs have one size for
all lengths of a class and count from the nearer end of the line, so that most lengths ask
for the same runs. Each line is filed under its runs with their number and size, and looks
up the runs that the multi-match-aware bounds leave for each length up to the threshold
shorter. A first pass only counts the keys; a second takes the lines of the keys that
several lines share. Pairs are not made of
all the lines of a key: a line first meets the earliest line of its key and length that agrees in a
quarter of the sketch (the parity of its symbols by hash, 64 bits, of which an edit turns at
most two), which settles large groups of near copies by as many tests as lines. What that
leaves meets the lines before it under the key with a length within the threshold, in a join
whose condition holds the sketches against each other. Candidates are verified by a banded bit-parallel automaton: one word
of bits, a bit for each diagonal of the band, for every number of edits, moved on symbol by
symbol.

Tables are broadcast only where they were counted and have at most `small` rows; beyond
that the same joins sort and merge.

Defined cases: null text stays null and empty text empty; rows with a null id keep their
text; rows with the same id count as one document, and repeated rows are returned as
often as they come; an empty table gives no rows. Other columns pass through, whatever their
names; those called _lines or _removed are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune

MIN_CHARS = 24
MIN_WORDS, TWO, THREE = 8, 18, 32
MOST = 3
#: Words from which on a run has how many (and the threshold there), below THREE words; beyond, lines of one STEP have runs of one size.
RUNS = ((8, 1, 4), (12, 1, 6), (TWO, 2, 6), (24, 2, 8))
STEP = 16
#: Rows of numbers that a broadcast table may have.
SMALL = 1_000_000


def allowed(by_word: Column, n: Column) -> Column:
    """Edits that two lines may be apart of which the shorter has n symbols."""
    return F.when(~by_word | (n < TWO), 1).when(n < THREE, 2).otherwise(MOST)


def probes(n: int, by_word: bool) -> list[tuple[int, int, int, int, int, bool]]:
    """What a line of n symbols is filed under and looks up: (threshold, segment, move, size, step, filed) of each key.

    A size of 0 stands for STEP / (MOST + 1) symbols by every whole STEP of the length, less
    `step` of them; for lines compared by characters, for half of the length less `step`.
    A line looks up lines that are as long or up to the threshold shorter, whose segments can
    stand where the multi-match-aware bounds say. Lengths that ask for the same run give one key.
    """
    out: dict[tuple[int, int, int, int, int], bool] = {}
    for less in range(MOST + 1):
        m = n - less
        if not by_word:
            t, size, step = 1, 0, less
        elif m >= THREE:
            t, size, step = MOST, 0, n // STEP - m // STEP
        else:
            t, size, step = next(((t, g, 0) for least, t, g in reversed(RUNS) if m >= least), (0, 0, 0))
        for i in range(t + 1 if less <= t and t else 0):
            for move in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                key = (t, i, move if 2 * i <= t else move - less, size, step)
                out[key] = out.get(key, False) or (less == 0 and move == 0)
    return [(*k, filed) for k, filed in out.items()]


def plan_of(by_word: Column, n: Column) -> Column:
    """The probes of a line, as an array of structs from a constant table."""
    names = ("t", "i", "move", "size", "step", "filed")
    # from THREE + MOST words on, the place within a STEP alone matters; number 0 is for lines compared by characters
    top = THREE + MOST
    longer = [probes(top // STEP * STEP + STEP + k, True) for k in range(STEP)]
    table = [probes(k, k > 0) or [(0,) * 5 + (False,)] for k in range(top)] + longer
    # one text that is read once: thousands of literals stay in the driver's memory with every plan
    table = F.from_json(F.lit(json.dumps([[dict(zip(names, e, strict=True)) for e in es] for es in table])), "array<array<struct<t:int,i:int,move:int,size:int,step:int,filed:boolean>>>")
    return F.get(table, F.when(by_word, F.when(n < top, n).otherwise(F.pmod(n, F.lit(STEP)) + top)).otherwise(0))


def key_of(c: Column, s: Column, by_word: Column, n: Column) -> Column:
    """Key of a probe: hash of a run of symbols with the number and the size of its segment."""
    by_length = F.when(by_word, ((n / STEP).cast("int") - c["step"]) * (STEP // (MOST + 1))).otherwise(((n - c["step"]) / 2).cast("int"))
    size = F.when(c["size"] > 0, c["size"]).otherwise(by_length)
    # the first segments count from the front, the last ones from the end
    start = F.when(c["i"] * 2 <= c["t"], c["i"] * size).otherwise(n - (c["t"] + 1 - c["i"]) * size) + c["move"]
    return F.xxhash64(c["t"], c["i"], by_word, F.when(by_word, size).otherwise(n - c["step"]), F.slice(s, start + 1, size))


def sketch(s: Column) -> Column:
    """Parity of the symbols in 64 classes of hashes; an edit turns at most two bits."""
    return F.aggregate(s, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(F.lit(63)).cast("int"))))


def _shared(x: Column, y: Column, most: Column, end: bool) -> Column:
    """Length of the common prefix (or suffix) of two arrays up to `most`, by halving steps."""

    def same(m: Column) -> Column:
        return F.slice(x, F.size(x) - m + 1, m) == F.slice(y, F.size(y) - m + 1, m) if end else F.slice(x, 1, m) == F.slice(y, 1, m)

    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda m, s: F.when((s <= most - m) & F.when(s <= most - m, same(m + s)).otherwise(False), m + s).otherwise(m))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def close(x: Column, y: Column, edits: Column, most: int = MOST) -> Column:
    """Whether two arrays are at most `edits` (1 to `most`) edits apart.

    Common ends are cut off first. Then bit d + most of word e says that the first
    j + d symbols of one array can be had from the first j of the other by e edits.
    """
    band = (1 << (2 * most + 1)) - 1

    def run(c: Column) -> Column:
        u, v, la, lb, least = c["u"], c["v"], c["la"], c["lb"], c["edits"]

        def step(state: Column, j: Column) -> Column:
            match = F.lit(0)
            for d in range(-most, most + 1):
                inside = (j + d >= 1) & (j + d <= la)
                match = match + F.when(inside & (F.get(u, j + d - 1) == F.get(v, j - 1)), 1 << (d + most)).otherwise(0)

            def words(m: Column) -> Column:
                def word(e: int, rest: list[Column]) -> Column:
                    old = state[f"e{e}"].bitwiseAND(m)
                    if e:
                        fewer = state[f"e{e - 1}"]
                        old = old.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(rest[-1], 1)).bitwiseAND(F.lit(band))
                    if e == most:
                        return F.struct(*[w.alias(f"e{k}") for k, w in enumerate([*rest, old])])
                    return _let(old, lambda w: word(e + 1, [*rest, w]))

                return word(0, [])

            return _let(match, words)

        start = F.struct(*[F.lit(sum(1 << (d + most) for d in range(e + 1))).alias(f"e{e}") for e in range(most + 1)])
        last = F.aggregate(F.sequence(F.lit(1), lb), start, step)
        word = last[f"e{most}"]
        for e in range(most - 1, 0, -1):
            word = F.when(least == e, last[f"e{e}"]).otherwise(word)
        end = F.lit(False)
        for d in range(-most, most + 1):
            end = end | ((la - lb == d) & (F.shiftright(word, d + most).bitwiseAND(F.lit(1)) == 1))
        rewritten = F.greatest(la, lb) <= least  # rewriting all that is left is within the threshold
        return F.when(F.abs(la - lb) > least, False).when(rewritten, True).when(F.least(la, lb) == 0, False).otherwise(end)

    def cut(ab: Column) -> Column:
        def ends(s: Column) -> Column:
            la, lb = F.size(ab["a"]) - s, F.size(ab["b"]) - s
            return _let(F.struct(F.slice(ab["a"], 1, la).alias("u"), F.slice(ab["b"], 1, lb).alias("v"), la.alias("la"), lb.alias("lb"), ab["edits"].alias("edits")), run)

        return _let(_shared(ab["a"], ab["b"], F.least(F.size(ab["a"]), F.size(ab["b"])), True), ends)

    def start(p: Column) -> Column:
        return _let(F.struct(F.slice(x, p + 1, F.size(x)).alias("a"), F.slice(y, p + 1, F.size(y)).alias("b"), edits.alias("edits")), cut)

    return _let(_shared(x, y, F.least(F.size(x), F.size(y)), False), start)


def worded(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def normal(line: Column) -> Column:
    # trimming spaces alone looks at the ends only
    return F.lower(F.when(line.contains("\t") | line.contains("\r"), F.btrim(line, F.lit(" \t\r"))).otherwise(F.trim(line)))


class LineJoin:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, min_chars: int, small: int):
        self.spark = tune(docs.sparkSession)
        self.scratch = Scratch(self.spark)
        self.id_col, self.text_col, self.min_chars, self.small = id_col, text_col, min_chars, small
        self.rows = docs.select(F.struct("*").alias("row"))

    def sized(self, df: DataFrame, weight: Column | None = None) -> DataFrame:
        """df, written and hinted for a join: broadcast if it has at most `small` rows, else to merge."""
        df = self.scratch.write(df)
        rows = df.agg(F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        return F.broadcast(df) if rows <= self.small else df.hint("merge")

    def own(self, name: str) -> Column:
        return F.col("row")[name]

    def lines(self) -> DataFrame:
        text = self.rows.select(self.own(self.id_col).alias("id"), self.own(self.text_col).alias("text")).where("id is not null and text is not null")
        text = text.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        # held against the line as it stands, so that most lines are normalised once, below
        text = text.where(worded(F.col("line")) | (F.length(normal(F.col("line"))) >= self.min_chars)).select("id", "pos", normal(F.col("line")).alias("line"))
        return text.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(7), "line"))

    def symbols(self, line: Column) -> tuple[Column, Column]:
        """Whether a line is compared by words, and its symbols with line feeds between them; null where it takes no part in the edit join."""
        # a plain replacement where single spaces separate the words, which is most often
        wide = line.contains("  ") | line.contains("\t") | line.contains("\r")
        words = F.when(wide, F.regexp_replace(line, r"[ \t\r]+", "\n")).otherwise(F.replace(line, F.lit(" "), F.lit("\n")))
        by_word = F.octet_length(F.substring_index(words, "\n", MIN_WORDS - 1)) < F.octet_length(words)
        return by_word, F.when(by_word, words).when(F.length(line) >= self.min_chars, F.array_join(F.split(line, ""), "\n"))

    def keys(self, lines: DataFrame) -> DataFrame:
        s, by_word, n = F.col("s"), F.col("by_word"), F.col("n")
        # one row for each probe before its key is formed, as keys are then formed in generated code
        out = lines.select("id", "pos", "h", "s", "by_word", "n", F.explode(plan_of(by_word, n)).alias("c"))
        out = out.select("id", "pos", "h", key_of(F.col("c"), s, by_word, n).alias("key"), "c.filed")
        return out.select("key", "id", "pos", "h", "filed")

    def verified(self, pairs: DataFrame, lines: DataFrame) -> DataFrame:
        """Late ends (id, pos, h) of those pairs(late, early) that are within the threshold."""
        pairs = self.scratch.write(pairs)
        ends = self.sized(pairs.select(F.explode(F.array("late", "early")).alias("o")).distinct())
        texts = self.scratch.write(lines.join(ends.select("o.*"), ["id", "pos", "h"], "left_semi").select(F.struct("id", "pos", "h").alias("o"), "s", "by_word"))
        late, early = texts.select(F.col("o").alias("late"), F.col("s").alias("u"), "by_word"), texts.select(F.col("o").alias("early"), F.col("s").alias("v"))
        both = pairs.join(late, "late").join(early, "early")
        return both.where(close(F.col("u"), F.col("v"), allowed(F.col("by_word"), F.least(F.size("u"), F.size("v"))))).select("late.*").distinct()

    def near(self, classes: DataFrame) -> DataFrame:
        """(id, pos, h) of the classes' lines that have a line before them within the threshold."""
        lines = classes.where("symbols is not null").select("id", "pos", "h", "by_word", F.split("symbols", "\n").alias("s")).withColumn("n", F.size("s"))
        keys = self.keys(lines)
        shared = self.sized(keys.groupBy("key").agg(F.count("*").alias("c"), F.max("filed").alias("f")).where("c > 1 and f").select("key"))
        self.scratch.sweep()
        found = self.scratch.write(keys.join(shared, "key"))
        some = self.sized(found.select("id", "pos", "h").distinct())
        lines = self.scratch.write(lines.join(some, ["id", "pos", "h"], "left_semi").select("id", "pos", "h", "s", "n", "by_word", sketch(F.col("s")).alias("sk")))
        light = self.sized(lines.select("id", "pos", "h", "n", "by_word", "sk"))
        found = found.join(light, ["id", "pos", "h"]).select("key", "filed", F.struct("id", "pos", "h").alias("o"), "n", "by_word", "sk")
        found = self.scratch.write(found)

        def fits(x: str, y: str) -> Column:
            """Of two rows of a key, whether x stands before y and no bound excludes them."""
            t = allowed(F.col(f"{y}.by_word"), F.least(f"{x}.n", f"{y}.n"))
            apart = F.bit_count(F.col(f"{x}.sk").bitwiseXOR(F.col(f"{y}.sk")))
            return (F.col(f"{x}.o") < F.col(f"{y}.o")) & (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= t) & (apart <= 2 * t)

        quarter = F.explode(F.array(*[F.shiftrightunsigned("sk", 16 * k).bitwiseAND(F.lit(0xFFFF)) * 4 + k for k in range(4)]))
        me = F.struct("o", "n", "by_word", "sk")
        parted = found.select("key", "n", quarter.alias("q"), "filed", me.alias("me"))
        lead = parted.groupBy("key", "n", "q").agg(F.min(F.when(F.col("filed"), F.col("me"))).alias("first_filed"), F.min("me").alias("first"))
        pairs = parted.join(lead, ["key", "n", "q"]).withColumn("lead", F.when(F.col("filed"), F.col("first")).otherwise(F.col("first_filed")))
        done = self.scratch.write(self.verified(pairs.where(fits("lead", "me")).select(F.col("me.o").alias("late"), F.col("lead.o").alias("early")).distinct(), lines))

        rest = found.join(self.sized(done).select(F.struct("id", "pos", "h").alias("o")), "o", "left_anti")
        lengths = F.explode(F.sequence(F.col("n") - MOST, F.col("n") + MOST))
        x, y = found.select("key", "n", me.alias("x"), F.col("filed").alias("xf")), rest.select("key", lengths.alias("n"), me.alias("y"), F.col("filed").alias("yf"))
        pairs = x.join(y, ["key", "n"]).where((F.col("xf") | F.col("yf")) & fits("x", "y")).select(F.col("y.o").alias("late"), F.col("x.o").alias("early")).distinct()
        return done.unionByName(self.verified(pairs, lines))

    def gone(self) -> DataFrame:
        """(id, gone): position and hash of the lines that go, for each id that loses any."""
        lines = self.lines()
        classes = lines.groupBy("h", "g").agg(F.min(F.struct("id", "pos", "line")).alias("first"), F.count("*").alias("copies"))
        by_word, symbols = self.symbols(F.col("first.line"))
        classes = self.scratch.write(classes.select("h", "g", "copies", "first.id", "first.pos", by_word.alias("by_word"), symbols.alias("symbols")))
        self.scratch.sweep()
        near = self.sized(self.near(classes).withColumn("near", F.lit(True)))
        going = classes.drop("symbols").join(near, ["id", "pos", "h"], "left").where("near or copies > 1")
        going = self.sized(going.select("h", "g", "near", F.col("id").alias("id1"), F.col("pos").alias("pos1")))
        out = lines.select("id", "pos", "h", "g").join(going, ["h", "g"]).where("near or id <> id1 or pos <> pos1")
        out = self.scratch.write(out.groupBy("id").agg(F.collect_set(F.struct("pos", "h")).alias("gone")))
        self.scratch.sweep()
        return out

    def run(self) -> DataFrame:
        """docs with the text without the lines that go, and their numbers."""
        gone = self.sized(self.gone(), F.size("gone"))
        text = self.own(self.text_col)
        both = self.rows.withColumn("id", self.own(self.id_col)).join(gone, "id", "left")
        both = both.withColumn("all", F.split(text, "\n"))
        stays = lambda line, k: ~F.array_contains(F.col("gone"), F.struct(k.cast("int").alias("pos"), F.xxhash64(normal(line)).alias("h")))
        both = both.withColumn("left", F.when(F.col("gone").isNotNull(), F.filter("all", stays)))
        count = F.when(text.isNull(), 0).otherwise(F.size("all")).cast("long")
        fresh = F.col("row").withField(self.text_col, F.when(F.col("left").isNull() | text.isNull(), text).otherwise(F.array_join("left", "\n")))
        removed = F.when(F.col("left").isNull() | text.isNull(), 0).otherwise(F.size("all") - F.size("left")).cast("long")
        done = both.select(fresh.alias("row"), F.struct(count.alias("_lines"), removed.alias("_removed")).alias("new"))
        kept = [F.col("row")[c].alias(c) for c in self.rows.schema["row"].dataType.names if c not in ("_lines", "_removed")]
        return done.select(*kept, "new._lines", "new._removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, small: int = SMALL) -> DataFrame:
    """docs with repeated lines taken out of the text, and columns _lines and _removed: their numbers before and gone."""
    return LineJoin(docs, id_col, text_col, min_chars, small).run()


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated lines; a row goes if it lost lines and no word is left."""
    out = dedup_lines(docs, id_col, text_col)
    return out.where((F.col("_removed") == 0) | F.col(text_col).rlike(r"\S")).select(*docs.columns)
