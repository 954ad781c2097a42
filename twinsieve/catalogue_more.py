"""Further queries: subsets, run tables, diagnostics and selectors by training dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve import oracle as O
from twinsieve.catalogue import _PROXIES, both, one, pairs, proxies, query, r6, read, side
from twinsieve.operators import diagnostics as D
from twinsieve.operators import dynamics
from twinsieve.operators.selection import select
from twinsieve.plans import benchmarks as B
from twinsieve.plans import subsets as S

# ------------------------------------------------------------------ subsets


@query("SELECT conv_id AS i, turn AS rank, lang, source FROM conversations JOIN documents ON doc_id = conv_id")
def index_subset(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "lang", "source")
    chosen = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("i"), F.col("turn").alias("rank"))
    return S.by_positions(rows, chosen).select("i", "rank", "lang", "source")


@query("SELECT conv_id AS i, 'twice' AS fault FROM conversations GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT conv_id, 'unknown' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def selection_faults(spark, sf_dir):
    return S.faults(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("i")), read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("i")))


@query("SELECT doc_id AS i, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def records_ours(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "source")
    return S.records(rows, "ours", read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("i")))


@query("SELECT l_orderkey, l_linenumber, printf('ratio_%02d', CAST(round_even(l_discount * 100, 0) AS INTEGER)) AS ratio, printf('size_%04d', CAST(l_quantity AS INTEGER)) AS size FROM lineitem")
def budget_tags(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.ratio_tag(F.col("l_discount")).alias("ratio"), S.size_tag(F.col("l_quantity")).alias("size"))


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS both, count(*) FILTER (e.vec_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id")
def modality_alignment(spark, sf_dir):
    return S.alignment(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i")))


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY c_nationkey")
def results_once(spark, sf_dir):
    return S.once(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")


# ------------------------------------------------------------------ run tables

_NAMES = "['x_GQA_test', 'run/scienceqa', 'MMBench_DEV', 'my_TextVQA', 'pope.csv', 'other']"
_FOLDERS = "['out/ratio_05_ours', 'out/random_10', 'out/x', 'A_1/OURS']"


@query(f"""
WITH x AS (SELECT event_id, lower({_NAMES}[1 + event_id % 6]) AS n, {_FOLDERS}[1 + event_id % 4] AS d, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0.05 ELSE 10.0 END AS r FROM events)
SELECT event_id, CASE WHEN contains(n, 'gqa') THEN 'GQA' WHEN contains(n, 'science') THEN 'ScienceQA' WHEN contains(n, 'mmbench') THEN 'MMBench' WHEN contains(n, 'textvqa') THEN 'TextVQA' WHEN contains(n, 'pope') THEN 'POPE' END AS benchmark,
  CASE WHEN r < 1 THEN 5 WHEN r >= 1 THEN 10 WHEN d = 'out/ratio_05_ours' THEN 5 WHEN d = 'out/x' THEN NULL ELSE 1 END AS ratio,
  CASE WHEN contains(d, 'random') THEN 'random' WHEN contains(lower(d), 'ours') THEN 'ours' ELSE '' END AS mode FROM x""")
def run_names(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    names, folders = (F.expr("array(" + t[1:-1] + ")") for t in (_NAMES, _FOLDERS))
    e = e.withColumn("n", F.get(names, (F.col("event_id") % 6).cast("int"))).withColumn("d", F.get(folders, (F.col("event_id") % 4).cast("int")))
    share = F.when(F.col("event_id") % 3 == 1, 0.05).when(F.col("event_id") % 3 == 2, 10.0)
    return e.select("event_id", B.benchmark(F.col("n")).alias("benchmark"), B.ratio(share, F.col("d")).alias("ratio"), B.mode(F.lit(None).cast("string"), F.col("d")).alias("mode"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN CASE WHEN l_tax BETWEEN 0 AND 1 THEN l_tax * 100 ELSE l_tax END ELSE CASE WHEN l_discount BETWEEN 0 AND 1 THEN l_discount * 100 ELSE l_discount END END, 6) AS metric FROM lineitem")
def main_metric(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_tax")).alias("Overall"), F.col("l_discount").alias("f1"))
    return rows.select("l_orderkey", "l_linenumber", F.round(B.main_metric(rows.select("Overall", "f1")), 6).alias("metric"))


@query("SELECT l_orderkey, l_linenumber, round((coalesce(a, 0) + b + c) / (2 + (a IS NOT NULL)::INTEGER), 6) AS mean FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity END AS a, l_tax AS b, l_discount AS c FROM lineitem)")
def mean_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("a"), F.col("l_tax").alias("b"), F.col("l_discount").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.round(B.mean_of(["a", "b", "c"]), 6).alias("mean"))


_ORDERS = "(SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey % 100)::DOUBLE AS recall, o_totalprice AS s, CASE WHEN o_orderkey % 7 > 0 THEN 1 + o_orderkey % 9 END AS e FROM orders)"


@query(f"""
SELECT k, round(recall / e, 6) AS recall_per_wh, round(recall / s, 9) AS recall_per_second, round(bs / s, 6) AS speedup, round(1 - e / be, 6) AS energy_saved
FROM {_ORDERS} LEFT JOIN (SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bs, CASE WHEN c_acctbal > 2000 THEN 5.0 END AS be FROM customer) USING (c)""")
def derived_metrics(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(key.alias("k"), F.col("o_custkey").alias("c"), (key % 100).cast("double").alias("recall"), F.col("o_totalprice").alias("s"), F.when(key % 7 > 0, 1 + key % 9).alias("e"))
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bs"), F.when(F.col("c_acctbal") > 2000, 5.0).alias("be"))
    out = B.derived(B.with_metrics(rows, base, "c"), "recall", "s", "e", "bs", "be")
    return out.select("k", *r6("recall_per_wh"), F.round("recall_per_second", 9).alias("recall_per_second"), *r6("speedup", "energy_saved"))


@query("SELECT doc_id, coalesce(quality, d.n_chars)::BIGINT AS size, lang FROM documents d LEFT JOIN labels USING (doc_id)")
def plan_precedence(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    tables = [d.select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("size")), d.select("doc_id", F.col("n_chars").alias("size"))]
    return B.by_precedence([tables[0].withColumn("size", F.lit(None).cast("long")), *tables[1:]], "doc_id", ["size", "lang"])


@query("SELECT user_id % 50 AS user_id, t.event_type FROM (SELECT DISTINCT user_id % 50 AS user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t WHERE (user_id, t.event_type) NOT IN (SELECT user_id % 50, event_type FROM events WHERE value > (SELECT quantile_disc(value, 0.99) FROM events))")
def metric_grid(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") % 50)
    cut = e.agg(F.expr("percentile_disc(0.99) within group (order by value)").alias("cut"))
    wanted = B.grid([e.select("user_id").distinct(), e.select("event_type").distinct()])
    rows = e.crossJoin(F.broadcast(cut)).where("value > cut").select("user_id", "event_type")
    return B.found_and_missing(wanted, rows, ["user_id", "event_type"])[1]


# ------------------------------------------------------------------ diagnostics


@query(O.with_ctes(*O.IMG, select="SELECT round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(min(w), 6) AS min, round(max(w), 6) AS max, count(*) AS nnz, round(count(*) / pow((SELECT count(*) FROM feats), 2), 6) AS density FROM img_g"))
def sparse_summary(spark, sf_dir):
    nodes, a = one(spark, sf_dir)
    return D.sparse_summary(a, nodes.count()).select(*r6("mean", "std", "min", "max"), "nnz", *r6("density"))


@query(O.with_ctes(O.FEATURES, """
x AS (SELECT unnest(img) AS x FROM feats)""", """
n AS (SELECT sqrt(list_dot_product(img, img)) AS n FROM feats)""", select="SELECT * FROM (SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM x), (SELECT round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std FROM n)"))  # fmt: skip
def response_stats(spark, sf_dir):
    return D.response_stats(side(spark, sf_dir, "img")).select(*r6("mean", "std", "min", "max", "norm_mean", "norm_std"))


@query(O.with_ctes(*O.IMG, """
d AS (SELECT i, greatest(sum(w), 1e-8) AS d FROM img_g GROUP BY i)""", select="""
SELECT round((SELECT sum(list_dot_product(txt, txt)) FROM feats) - (SELECT sum(w / sqrt(a.d * b.d) * list_dot_product(x.txt, y.txt)) FROM img_g g JOIN d a ON a.i = g.i JOIN d b ON b.i = g.j JOIN feats x ON x.i = g.i JOIN feats y ON y.i = g.j), 4) AS regularisation"""))  # fmt: skip
def graph_regularisation(spark, sf_dir):
    _, a = one(spark, sf_dir)
    return D.regularisation(a, side(spark, sf_dir, "txt")).select(F.round("regularisation", 4).alias("regularisation"))


@query(O.with_ctes(*O.IMG, """
s AS (SELECT i, sum(w) AS s FROM img_g GROUP BY i)""", select="""
SELECT i, round(v, 6) AS value, row_number() OVER (ORDER BY v, i) AS rank FROM (SELECT i, list_distance(img, list_transform(img, lambda x: 0.0)) - 0.1 * coalesce(s, 0) AS v FROM feats LEFT JOIN s USING (i))"""))  # fmt: skip
def centre_candidates(spark, sf_dir):
    _, a = one(spark, sf_dir)
    return D.ranked_for([0.0] * 32, side(spark, sf_dir, "img"), a.groupBy("i").agg(F.sum("w").alias("score"))).select("i", *r6("value"), "rank")


@query(O.with_ctes(O.FEATURES, select="SELECT i, place FROM (SELECT vec_id AS i, row_number() OVER (ORDER BY label, embedding[1], vec_id) - 1 AS place FROM embeddings), (SELECT count(*) AS n FROM feats) WHERE place IN (SELECT floor(k * ((n - 1) / 49.0)) FROM range(50) t(k), (SELECT count(*) AS n FROM feats))"))
def shown_nodes(spark, sf_dir):
    nodes = pairs(spark, sf_dir).select("i", "label", F.col("img")[0].alias("x"))
    return D.shown(D.node_order(nodes, ["label", "x"]), 50).select("i", "place")


@query("SELECT event_id, round(ln(1 + least(greatest(value, 0), q99) / greatest(q10, 1e-8)), 6) AS scaled FROM events, (SELECT quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.99) AS q99 FROM events WHERE value > 0)")
def log_scaled(spark, sf_dir):
    return D.log_scaled(read(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))).select("event_id", *r6("scaled"))


@query(O.with_ctes(*O.BOTH, select="SELECT i, round(sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), 6) AS change FROM img_g a FULL JOIN txt_g b USING (i, j) GROUP BY i"))
def local_changes(spark, sf_dir):
    _, a, b = both(spark, sf_dir)
    return D.changes(a, b).select("i", *r6("change"))


@query(O.with_ctes(O.FEATURES, _PROXIES, select="SELECT round(-avg(ln(c + 1e-8)), 6) AS wave_coverage FROM (SELECT avg(exp(-pow(list_distance(f.img, p.v), 2))) AS c FROM feats f, proxies p GROUP BY f.i)"))
def wave_coverage(spark, sf_dir):
    return D.wave_coverage(side(spark, sf_dir, "img"), proxies(spark, sf_dir)).select(*r6("wave_coverage"))


@query(O.with_ctes(*O.IMG, """
s AS (SELECT i, sum(w) AS s FROM img_g GROUP BY i)""", """
t AS (SELECT i, s FROM s ORDER BY round(s, 9) DESC, i LIMIT 25)""", select="SELECT count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max FROM t"))  # fmt: skip
def selection_summary(spark, sf_dir):
    _, a = one(spark, sf_dir)
    scores = a.groupBy("i").agg(F.sum("w").alias("score"))
    chosen = scores.orderBy(F.round("score", 9).desc(), "i").limit(25)
    return D.selection_summary(chosen, scores).select("n", *r6("mean", "min", "max"))


# ------------------------------------------------------------------ selectors by training dynamics


def _selector(name: str):
    def run(spark, sf_dir):
        return select(name, pairs(spark, sf_dir), 25).select("i", "rank", F.round("score", 4).alias("score"))

    run.__name__ = f"sel_{name}"
    return query()(run)


sel_el2n, sel_forget, sel_dynamic_pruning = map(_selector, ("el2n", "forget", "dynamic_pruning"))
assert dynamics.history  # the import registers the methods
