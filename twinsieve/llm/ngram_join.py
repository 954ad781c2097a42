"""N-gram Jaccard join over signature trees.

Words are runs of bytes without white space, A-Z in lower case. The set of a text
holds its distinct runs of five words; a text of one to four words has its whole
sequence as its one element; a text without words has an empty set and no links.
Two rows link when den * |intersection| >= num * |union|. Every link is confirmed on
the whole sets; sets are compared by 64-bit hashes of their elements.

How the work is dealt out
-------------------------
1. One pass over the texts gives each row the size of its set, a 128-bit sum of it, six
   minimum hashes and a bitmap; and, per task, counts of elements by hash bucket. The
   bucket counts add up to one array of fixed size, which the driver broadcasts.
2. Rows with equal sets form a class and the smallest id stands for it.
3. Rounds over the minimum hashes link each row to one leader of its bucket. That joins
   the members of large groups by as many links as there are members, not pairs.
4. The pass that makes the result whole: elements are ordered by (bucket count, hash),
   and each row emits its first size - ceil(num / den * size) + 1 elements. Rows that
   link share one of these. Rows without a partner by size and place, and elements of one
   component alone, fall away; the rest get their bitmaps and form blocks. The order puts passages that many texts share last,
   where they are rarely emitted.
5. In each block a signature tree is traversed against itself; large blocks are cut
   into cells of at most `cell` rows, each pair of cells a task of its own. Pairs that
   no bound excludes are compared on the sets, and confirmed links complete the
   components.

Rows with null text or a null id are returned, linked with nothing; a null id has a
null component. Repeated rows are returned as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, grams, mix, per_batch, text_bytes, tune, words_of
from .components import components
from .signature_tree import Tree, halved, join, signature, width

WORDS = 5
BUCKETS = 1 << 20
BLOCK = 1 << 12
HASHES = 6
FILTER_BITS = 1 << 22
_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(col: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct element hashes of each row."""
    data, offsets = text_bytes(col)
    hashes, starts, _ = words_of(data, offsets, lower=True)
    cut = np.searchsorted(starts, offsets)
    runs = grams(hashes, n)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            yield grams(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "f1", "f2", "mh", "sig")}
            for own in shingle_sets(batch.column(1), n):
                rows["n"].append(len(own))
                rows["f1"].append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                rows["f2"].append(int(mix(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                rows["mh"].append(np.array([mix(own ^ s).min() for s in _SALTS]).view(np.int64) if len(own) else np.zeros(0, np.int64))
                rows["sig"].append(signature(own))
                np.add.at(counts, (own & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["f1"], pa.int64()), pa.array(rows["f2"], pa.int64()), pa.array(rows["mh"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["id", "n", "f1", "f2", "mh", "sig", "block", "counts"],
            )
        blocks = [(k, counts[k * BLOCK : (k + 1) * BLOCK]) for k in range(BUCKETS // BLOCK)]
        blocks = [(k, x) for k, x in blocks if x.any()]
        m = len(blocks)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64())] + [pa.nulls(m, pa.int64())] * 3 + [pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.array([k for k, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())],
                names=["id", "n", "f1", "f2", "mh", "sig", "block", "counts"],
            )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = np.frombuffer(x.as_buffer(), dtype=np.int32)
            total[k] = total[k] + new if k in total else new.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def bucket_counts(described: DataFrame) -> np.ndarray:
    """Elements by hash bucket over all rows: an array of BUCKETS numbers, whatever the input."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    parts = described.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(_add_counts, "block int, counts binary")
    got = parts.toArrow()
    for block, counts in zip(got.column("block").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, dtype=np.int64)
    return out


def _prefixes(n: int, num: int, den: int, order):
    """The first elements of each row, in the order of (bucket count, hash), with the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            tokens, rows, places, sizes = [], [], [], []
            for k, own in enumerate(shingle_sets(batch.column(1), n)):
                if len(own):
                    m = len(own) - -(-num * len(own) // den) + 1
                    weight = counts[(own & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    cut = np.partition(weight, m - 1)[m - 1]
                    low, ties = np.flatnonzero(weight < cut), np.flatnonzero(weight == cut)
                    # own is sorted by hash, so the first ties are those of the least hash
                    first = np.sort(np.concatenate([low, ties[: m - len(low)]]))
                    first = first[np.argsort(weight[first], kind="stable")]
                    tokens.append(own[first].view(np.int64))
                    rows.append(np.full(m, k, dtype=np.int32))
                    places.append(np.arange(m, dtype=np.int32))
                    sizes.append(np.full(m, len(own), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))], names=["token", "id", "place", "n"])

    return run


def early(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements that the smaller of two linked sets needs to be filed under: one of them is in the prefix of the larger.

    Two sets that link share at least 2 num / (num + den) of the smaller one.
    """
    return size - -(-2 * num * size // (num + den)) + 1


def _met(num: int, den: int):
    """Rows that may have a partner under their token; the input is sorted by (token, n, place).

    Of two linked sets the smaller has a shared token among its first `early` elements and
    the larger has it in its prefix. So a late row needs an early one before it, of no less
    than num / den of its size; an early row needs that, or any row after it of no more than
    den / num of its size. Both are seen in the nearest such row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        token0, size0 = None, 0  # token and size of the last early row that was sent on or dropped
        for batch in (*batches, None):
            last = batch is None
            if last:
                if held is None:
                    return
                batch, tail = held, 0
            else:
                batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                tail = 1
            token, place, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            n = n.astype(np.int64)
            m = len(token)
            first = place < early(n, num, den)
            # nearest early row before each row, of the same token
            at = np.where(first, np.arange(m), -1)
            before = np.maximum.accumulate(np.concatenate([[-1], at[:-1]]))
            has = (before >= 0) & (token[before] == token)
            size = np.where(has, n[before], 0)
            if token0 is not None:
                size = np.where((before < 0) & (token == token0), size0, size)
            keep = (size > 0) & (den * size >= num * n)
            nxt = (token[1:] == token[:-1]) & (num * n[1:] <= den * n[:-1])
            keep[:-1] |= first[:-1] & nxt
            out = keep[: m - tail]
            if out.any():
                yield batch.slice(0, m - tail).filter(pa.array(out))
            gone = np.flatnonzero(first[: m - tail])
            if len(gone):
                token0, size0 = token[gone[-1]], int(n[gone[-1]])
            held = batch.slice(m - tail) if tail else None

    return run


def _cells(num: int, den: int):
    """Candidate pairs of each (token, ci, cj) block; the input is sorted by these."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, comp, sizes, place, side = (t.column(k).to_numpy() for k in ("id", "comp", "n", "place", "side"))
        ci, cj = t.column("ci")[0].as_py(), t.column("cj")[0].as_py()
        sig = t.column("sig").to_pylist()
        wide = width(sizes)
        found = []
        trees: dict[tuple[int, int, bool], tuple[np.ndarray, Tree] | None] = {}

        def tree(w: int, own: int, half: bool) -> tuple[np.ndarray, Tree] | None:
            """Rows of one width and side, with their bitmaps as they are or halved."""
            if (w, own, half) not in trees:
                at = np.flatnonzero((wide == w) & (side == own))
                bits = np.frombuffer(b"".join([sig[k] for k in at]), dtype=np.uint64).reshape(len(at), -1) if len(at) else None
                trees[w, own, half] = None if bits is None else (at, Tree(sizes[at], halved(bits) if half else bits))
            return trees[w, own, half]

        def meet(x: tuple[np.ndarray, Tree] | None, y: tuple[np.ndarray, Tree] | None) -> None:
            if x is None or y is None:
                return
            for i, j in join(x[1], None if x is y else y[1], num, den):
                i, j = x[0][i], y[0][j]
                left = np.minimum(sizes[i] - place[i], sizes[j] - place[j])
                keep = (comp[i] != comp[j]) & ((num + den) * left >= num * (sizes[i] + sizes[j]))
                if keep.any():
                    found.append((ids[i[keep]], ids[j[keep]]))

        for w in np.unique(wide).tolist():
            meet(tree(w, ci, False), tree(w, cj, False))
            meet(tree(w, ci, False), tree(w + 1, cj, True))
            if ci != cj:
                meet(tree(w, cj, False), tree(w + 1, ci, True))
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return _by_key(3, block)


def _by_key(n_keys: int, fn):
    """Call fn on the batches of each key; the input is sorted by its first n_keys columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                own = tuple(c[s] for c in cols)
                if key is not None and own != key:
                    if (out := fn(parts)) is not None:
                        yield out
                    parts = []
                key = own
                parts.append(batch.slice(s, e - s))
        if parts and (out := fn(parts)) is not None:
            yield out

    return run


def _confirm(num: int, den: int):
    """Links among (a, salt, b, tokens); the row with b null has the set of a and comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for batch in batches:
            found_a, found_b = [], []
            a, salt, b = (batch.column(k).to_pylist() for k in range(3))
            for k, tokens in enumerate(batch.column(3)):
                own = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                if b[k] is None:
                    key, mine = (a[k], salt[k]), own.copy()
                elif key == (a[k], salt[k]):
                    both = np.sort(np.concatenate([mine, own]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if den * shared >= num * (len(both) - shared):
                        found_a.append(a[k])
                        found_b.append(b[k])
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


class JaccardJoin:
    """The steps over one table, with their parameters."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, cell: int):
        self.spark: SparkSession = tune(docs.sparkSession)
        self.scratch = Scratch(self.spark)
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.n, self.num, self.den, self.cell = n, num, den, cell

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) of ids -> those that link, by their whole sets."""
        n = self.n
        pairs = self.scratch.write(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
        # a bitmap of fixed size: texts that no pair names are left out before the shuffle
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        width = 32768
        for row in ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect():
            start = (row.k - 1) * width // 8
            if start >= 0:
                bits[start : start + width // 8] = np.frombuffer(row.m, dtype=np.uint8)[: width // 8]
        zero = ids.where(place == 0).limit(1).count() > 0
        shared = self.spark.sparkContext.broadcast(bits)

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            # positions 1..width of bucket k are bits 0..width-1
            at1 = np.maximum(at - 1, 0)
            named = ((shared.value[at1 >> 3] >> (at1 & 7).astype(np.uint8)) & 1).astype(bool)
            named = np.where(at == 0, zero, named)
            batch = batch.filter(pa.array(named))
            tokens = [own.tobytes() for own in shingle_sets(batch.column(1), n)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["id", "tokens"])

        named = self.scratch.write(self.texts.where("id is not null").withColumn("at", place).mapInArrow(per_batch(sets), "id long, tokens binary"))
        count = pairs.groupBy("a").agg(F.count("*").alias("c"))
        dealt = pairs.join(count, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 256)).alias("salt"), "b")
        wanted = dealt.select(F.col("b").alias("id"), "a", "salt", "b").unionByName(dealt.select(F.col("a").alias("id"), "a", "salt").distinct().withColumn("b", F.lit(None).cast("long")))
        rows = wanted.join(named, "id").select("a", "salt", "b", "tokens").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        links = self.scratch.write(rows.mapInArrow(_confirm(self.num, self.den), "a long, b long"))
        for used in (named, pairs):
            self.scratch.drop(used)
        self.scratch.sweep()
        return links

    def run(self) -> DataFrame:
        num, den = self.num, self.den
        described = self.scratch.write(self.texts.mapInArrow(_describe(self.n), "id long, n long, f1 long, f2 long, mh array<long>, sig binary, block int, counts binary"))
        rows = described.where("block is null")
        full = rows.where("id is not null and n > 0")
        classes = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("mh").alias("mh"), F.first("sig").alias("sig"))
        classes = self.scratch.write(classes)

        links = None
        comp = None
        # leaders: in two rounds over half of the minimum hashes each, the second among what the first left apart
        for half in range(2):
            hashes = classes.select("rep", "n", F.posexplode(F.slice("mh", 1 + half * (HASHES // 2), HASHES // 2)).alias("k", "h"))
            hashes = hashes.withColumn("comp", F.col("rep")) if comp is None else hashes.join(comp, hashes.rep == comp.id, "left").select("rep", "n", "k", "h", F.coalesce("comp", "rep").alias("comp"))
            lead = hashes.groupBy("k", "h").agg(F.min(F.struct("comp", "rep", "n")).alias("lead"), F.max("comp").alias("most")).where("lead.comp <> most")
            pairs = hashes.join(lead, ["k", "h"]).where("comp <> lead.comp").where(F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num)
            pairs = pairs.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
            got = self.confirm(pairs)
            links = got if links is None else links.unionByName(got)
            comp = components(links, self.scratch)

        order = self.spark.sparkContext.broadcast(bucket_counts(described).astype(np.int64))
        kinds = "token long, id long, place int, n int"
        tokens = self.texts.where("id is not null").mapInArrow(_prefixes(self.n, num, den, order), kinds)
        tokens = self.scratch.write(tokens.repartition("token").sortWithinPartitions("token", "n", "place").mapInArrow(_met(num, den), kinds))
        self.scratch.sweep()
        rep = self.scratch.write(classes.select(F.col("rep").alias("id"), "sig").join(comp, "id", "left").select("id", "sig", F.coalesce("comp", "id").alias("comp")))
        owned = self.scratch.write(tokens.join(rep.select("id", "comp"), "id").distinct())
        self.scratch.drop(tokens)
        mixed = owned.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("c") / self.cell).alias("m"))
        # of what is left once more those with a partner, now that copies are gone; only these get their bitmaps
        left = owned.join(mixed, "token").repartition("token").sortWithinPartitions("token", "n", "place").select("token", "id", "place", "n", "comp", "m")
        left = self.scratch.write(left.mapInArrow(_met(num, den), "token long, id long, place int, n int, comp long, m long"))
        self.scratch.drop(owned)
        self.scratch.sweep()
        blocks = left.join(rep.select("id", "sig"), "id").withColumn("side", F.pmod(F.xxhash64("id"), "m"))
        blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select("token", F.least("side", "o").alias("ci"), F.greatest("side", "o").alias("cj"), "side", "id", "comp", F.col("n").cast("long").alias("n"), "place", "sig")
        found = blocks.repartition("token", "ci", "cj").sortWithinPartitions("token", "ci", "cj").mapInArrow(_cells(num, den), "a long, b long").distinct()
        links = links.unionByName(self.confirm(found))
        comp = components(links, self.scratch)

        reps = classes.select("f1", "f2", "n", "rep").join(comp, classes.rep == comp.id, "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("component_id"))
        return (
            rows.select(F.col("id"), "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), F.when(F.col("n") > 0, F.col("f2")).alias("f2"))
            .join(reps.withColumnRenamed("n", "m"), ["f1", "f2"], "left")
            .where("m is null or m = n")
            .select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, num: int = 80, den: int = 100, cell: int = 2048) -> DataFrame:
    """docs -> (id_col, n_shingles, component_id), a row for each row of docs.

    component_id is the smallest id reachable by links, the row's own included. Other
    columns of docs are not read. An empty table gives no rows.
    """
    return JaccardJoin(docs, id_col, text_col, n, num, den, cell).run().withColumnRenamed("id", id_col)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group: those whose id is their component's. Rows without an id stay."""
    own = near_duplicates(docs, id_col, text_col)
    others = own.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(others, id_col, "left_anti")
