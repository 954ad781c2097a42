import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.functions.scores import subset_size
from twinsieve.operators import correction, fusion, fuzzy, kernels, retrieval, selection
from twinsieve.operators import graph as G
from twinsieve.operators.knn import Nearest, knn, nearest
from twinsieve.sources import annotations, runs
from twinsieve.streaming import windowed

# a path, and pairs with two further edges: they share (0, 1), (2, 3) and (4, 5) of eight edges
IMAGE = [(k, k + 1, (5 + k) / 10) for k in range(5)] + [(5, 6, 0.4)]
TEXT = [(0, 1, 0.3), (2, 3, 0.5), (4, 5, 0.7), (0, 7, 0.2), (3, 6, 0.6)]


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("c")))
    make = lambda rows: spark.createDataFrame(rows + [(j, i, w) for i, j, w in rows], "i long, j long, w double")
    return make(IMAGE), make(TEXT), spark.range(8).withColumnRenamed("id", "i")


def test_two_small_graphs(graphs):
    a, b, nodes = graphs
    one = G.pair_similarity(a, b, nodes, 10).first()
    assert (one["support_intersection"], one["support_union"]) == (6, 16)
    assert one["support_jaccard"] == pytest.approx(3 / 8)
    assert correction.healthy({"collapse_score": 0.2, "spectral_entropy": 0.8}, {"collapse_score": 0.4, "spectral_entropy": 0.6}) == "image"
    x, y = correction.global_confidences(0.2, 0.4)
    assert x + y == pytest.approx(1) and x > y
    w = {(r.i, r.j): r.w for r in fusion.average(a, b).collect()}
    assert len(w) == 16 and w[0, 1] == pytest.approx(0.4) and w[7, 0] == pytest.approx(0.1)


def test_laplacian_rows_and_isolated_nodes(spark, graphs):
    a = graphs[0]
    nodes = spark.range(9).withColumnRenamed("id", "i")
    dense = kernels.dense(G.laplacian(a, nodes), nodes)[1]
    w = kernels.dense(a, nodes)[1]
    d = w.sum(1)
    want = np.diag((d > 0).astype(float)) - np.where(np.outer(d, d) > 0, w / np.sqrt(np.maximum(np.outer(d, d), 1e-300)), 0)
    assert np.allclose(dense, want)


def test_knn_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x[7] = x[8]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "i long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, r + 1): j for i in range(60) for r, j in enumerate([j for _, j in sorted((d[i, j], j) for j in range(60) if j != i)][:4])}
    for block in (4096, 16):
        assert {(r.i, r.rank): r.j for r in knn(df, 4, block=block).collect()} == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e30])
def test_nearest_of_blocks_is_brute_force(metric, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6))
    x[40:300], x[5], x[600:] = x[30], 0.0, x[600:] + 1e5
    x *= scale
    ids = rng.permutation(700) * 3 - 7
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    for with_self in (False, True):
        near = Nearest(ids, x, 9, metric, with_self)
        for s in range(0, 700, 130):
            near.meet(ids[s : s + 130], x[s : s + 130])
        ends = [(np.frombuffer(n, np.int32), np.frombuffer(j, np.int64), np.frombuffer(d, np.float64)) for _, n, j, d in near.rows()]
        assert (np.concatenate([n for n, _, _ in ends]) == 9).all()
        j, d = (np.concatenate([e[c] for e in ends]).reshape(700, 9) for c in (1, 2))
        for r in range(700):
            own = np.sqrt(((x[r] - x) ** 2).sum(axis=1)) if metric == "l2" else 1 - (u[r] * u).sum(axis=1)
            order = np.lexsort((ids, own))
            order = order[with_self | (ids[order] != ids[r])][:9]
            assert (j[r] == ids[order]).all() and (d[r] == own[order]).all()


def written(plan):
    """Rows that a plan dealt out anew, over all its shuffles, after it ran."""
    text = plan._jdf.queryExecution().executedPlan()
    found, left = 0, [text]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found += node.metrics().apply("shuffleRecordsWritten").value()
            left += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_knn_deals_out_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(200)], "i long, v array<double>").repartition(3)
    near = nearest(df, 3, block=16)
    assert len(near.collect()) == 200
    assert written(near) == 0


@pytest.mark.parametrize("name", ["entropy", "dataprophet"])
def test_selectors_deal_out_a_row_a_query(spark, monkeypatch, name):
    rng = np.random.default_rng(6)
    pairs = spark.createDataFrame([(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(120)], "i long, img array<double>, txt array<double>")
    plans = []
    monkeypatch.setattr(selection, "_best", lambda scored, k: plans.append(scored) or scored)
    monkeypatch.setattr(selection, "settle", lambda df: plans.append(df) or df, raising=False)
    selection.select(name, pairs, 5)
    assert plans[0].count() == 120
    plans[0].collect()
    assert 0 < written(plans[0]) <= 6 * 120  # a list of neighbours a query would be 32 rows and more


def test_lists_are_described_as_by_the_formulas(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.i: r for r in selection.described(rows, 8, 0.2).collect()}
    for i in range(90):
        d = 1 - u @ u[i]
        near = np.argsort(d)[:8]
        p = np.exp((1 - d[near]) / 0.2)
        p /= p.sum()
        assert got[i].j == near.tolist()
        assert got[i].entropy == pytest.approx(-(p * np.log(p)).sum()) and got[i].diversity == pytest.approx(d[near[1:]].mean())
    alone = selection.described(rows.where("i = 0"), 8).collect()
    assert len(alone) == 1 and alone[0].entropy == 0 and abs(alone[0].diversity) < 1e-12


def test_recall_in_group_forms_no_pairs(spark):
    labels = [1] * 150 + [2] * 48 + [3, None]
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(y) for y in rng.normal(size=4)], label) for i, label in enumerate(labels)], "i long, v array<double>, label int")
    ranks = knn(rows, 6, "cosine", with_self=True)
    best = {i: 99 for i in range(200)}
    for r in ranks.collect():
        if r.i != r.j and labels[r.i] is not None and labels[r.i] == labels[r.j]:
            best[r.i] = min(best[r.i], r.rank)
    got = retrieval.recall_in_group(ranks, rows, "label", (2, 6))
    row = got.collect()[0]
    assert row.r2 == pytest.approx(sum(b <= 2 for b in best.values()) / 2) and row.r6 == pytest.approx(sum(b <= 6 for b in best.values()) / 2)
    assert written(got) < 20 * 200  # of the pairs of equal labels there are 24,804


def weights_of(df):
    return {(r.i, r.j): r.w for r in df.collect()}


def test_recall_deals_out_no_rank_beyond_its_own(spark):
    ranks = spark.createDataFrame([(i, r, (i + r * r) % 50, r / 100) for i in range(50) for r in range(1, 41)], "i long, rank int, j long, dist double")
    truth = spark.range(50).selectExpr("id as i", "(id + 9) % 50 as j")
    got = retrieval.recall(ranks, truth, (1, 3))
    assert [tuple(r) for r in got.collect()] == [(0.0, 100.0)]
    assert written(got) <= 50 * 3 + 50 + 50 + 8


def test_union_meets_each_edge_once(spark):
    rows = [(0, 1, 0.5), (1, 0, 0.25), (2, 0, 0.5), (3, 3, 0.5), (1, 2, 1.0)]
    got = fuzzy.union(spark.createDataFrame(rows, "i long, j long, w double").repartition(3))
    once = {(0, 1): 0.625, (0, 2): 0.5, (1, 2): 1.0}
    want = once | {(j, i): w for (i, j), w in once.items()} | {(3, 3): 0.75}
    assert weights_of(got) == want
    plan = fuzzy.union(spark.createDataFrame(rows, "i long, j long, w double").repartition(3))
    plan.collect()
    assert written(plan) <= 5 + 5  # one row an edge, beside the repartition of the input
    assert weights_of(fuzzy.union_of_symmetric(got)) == weights_of(fuzzy.union(got))


def test_listed_graph_is_that_of_the_rows(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))], "i long, v array<double>")
    got, want = weights_of(fuzzy.listed_graph(nearest(rows, 7), 5)), weights_of(fuzzy.local_graph(knn(rows, 7), 5))
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-12) for e in want)


def test_shares_are_taken_of_edges_dealt_out_once(spark, graphs):
    a, b, _ = graphs
    n = a.count() + b.count()
    for make in (lambda: correction.confidence_weights(a, b, (0.5, 0.5), gated=False), lambda: G.edge_adjustment(None, a, b)):
        plan = make()
        plan.collect()
        assert written(plan) <= n + 8
    x, y = ({e: w * 0.5 / sum(v for (i, _), v in g.items() if i == e[0]) for e, w in g.items()} for g in (weights_of(a), weights_of(b)))
    for r in correction.confidence_weights(a, b, (0.5, 0.5), gated=False).collect():
        p, q = x.get((r.i, r.j), 0.0), y.get((r.i, r.j), 0.0)
        assert r.t2i == pytest.approx((q - p * q) / (q - p * q + 1e-8)) and r.i2t == pytest.approx((p - p * q) / (p - p * q + 1e-8))
    assert G.edge_adjustment(G.aligned(a=a, b=b), a, b).collect() == G.edge_adjustment(None, a, b).collect()
    few = G.edge_adjustment(b, a, b).collect()[0]
    assert few["total"] == b.count()


def test_fused_edges_are_dealt_out_twice(spark, graphs):
    a, b, _ = graphs
    plan = fusion.confidence_aware(a, b)
    plan.collect()
    assert written(plan) <= 2 * (a.count() + b.count())  # by row, then by edge


def test_assignment_is_the_cheapest():
    rng = random.Random(0)
    for _ in range(40):
        n = rng.randint(1, 5)
        m = rng.randint(n, 6)
        cost = np.array([[rng.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
        got = kernels.assign(cost)
        assert len(set(got)) == n
        assert cost[np.arange(n), got].sum() == min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), n))


def test_collapse_and_sizes():
    assert kernels.collapse(np.array([0.0, 1.0])) == (0.0, 1.0)
    h, c = kernels.collapse(np.array([0.0, 1.0, 1.0, 1.0]))
    assert h == pytest.approx(1) and c == pytest.approx(0)
    assert [subset_size(5, 0.5), subset_size(10, 0.25), subset_size(3, 0.001), subset_size(3, budget=9)] == [2, 2, 1, 3]


def test_proxies_come_nearer():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (3, 3), (-3, 3))])
    _, losses = kernels.optimise_proxies(points, rng.normal(size=(3, 2)), 150, 0.05)
    assert losses[-1] < losses[0]
    history = kernels.surrogate(points, points @ rng.normal(size=(2, 3)), 4, 8)
    assert history[-1][1].mean() < history[0][1].mean()


def test_registry():
    assert {"entropy", "presel", "visa", "dataprophet", "rand", "kcenter", "herd", "dq", "nms", "gradmatch", "glister", "dfool"} <= set(selection.METHODS)
    with pytest.raises(ValueError):
        selection.method("RAND")(lambda p, k: p)
    with pytest.raises(KeyError):
        selection.select("none", None, 1)


def test_annotation_files(spark, tmp_path):
    rows = [{"image": f"{k}.jpg", "caption": f"A  Dog; number {k}!", "image_id": x} for k, x in enumerate(["b", "a", "b"])]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "w.json").write_text(json.dumps({"annotations": rows}))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "c.csv").write_text("image,caption,image_id\n" + "\n".join(f'{r["image"]},"{r["caption"]}",{r["image_id"]}' for r in rows))
    for name in ("l.json", "w.json", "r.jsonl", "c.csv"):
        got = annotations.train_pairs(spark, str(tmp_path / name)).orderBy("sample_idx").collect()
        assert [(r.sample_idx, r.img_id, r.raw_image_id, r.caption) for r in got] == [(0, 0, "b", "a dog number 0"), (1, 1, "a", "a dog number 1"), (2, 0, "b", "a dog number 2")]
    with pytest.raises(ValueError):
        annotations.records(spark, "x.txt")
    (tmp_path / "e.json").write_text(json.dumps([{"image": "x", "caption": ["one", "two"]}, {"image": "y", "caption": ["three"]}]))
    images, texts = annotations.eval_pairs(spark, str(tmp_path / "e.json"))
    assert images.count() == 2 and [(r.txt_id, r.img_id, r.caption) for r in texts.orderBy("txt_id").collect()] == [(0, 0, "one"), (1, 0, "two"), (2, 1, "three")]


def test_runs_and_selections(spark, tmp_path):
    for seed in (0, 1):
        d = tmp_path / "runs" / f"budget_100/seed_{seed}"
        d.mkdir(parents=True)
        (d / "baseline_summary.json").write_text(json.dumps({"method": "herd", "selection_time": 1.5}))
        if seed:
            (d / "downstream_metrics.json").write_text(json.dumps({"mean_recall": 40.0}))
    got = {r.seed: r for r in runs.baseline_runs(spark, str(tmp_path / "runs")).collect()}
    assert got[0].budget == 100 and got[0].mean_recall is None and got[1].mean_recall == 40.0
    log = "x\n| 1 | 2 | 3 | 4 | 5 | 6 | 7 |\n| 0 | 0 | 0 | 0 | 0 | 0 | 0 |\n"
    (tmp_path / "a.log").write_text(log)
    line = runs.table_line(runs.log_lines(spark, str(tmp_path / "a.log")), "file", "nth", "text").first()
    assert line["values"] == [1, 2, 3, 4, 5, 6, 7]
    runs.write_selection(spark.createDataFrame([(5,), (2,)], "i long"), str(tmp_path / "sel"))
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare/s.json").write_text("[2, 5]")
    for p in ("sel", "bare"):
        assert sorted(r.i for r in runs.read_selection(spark, str(tmp_path / p)).collect()) == [2, 5]
    flat = runs.flattened(spark.createDataFrame([(1, '{"a": {"b": 2, "c": [1, 2.5]}, "d": true, "e": "x"}')], "k long, j string"), "k", "j")
    assert {(r.path, r.value) for r in flat.collect()} == {("a.b", 2.0), ("a.c.0", 1.0), ("a.c.1", 2.5)}
    assert runs.markdown(spark.createDataFrame([(1, None)], "a int, b int")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_stream_of_samples(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "value", "event_type").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): (r.n, r.mean) for r in spark.table("win").collect()}
    want = {(r.start, r.event_type): (r.n, r.mean) for r in windowed(events, "ts", "value", "event_type").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_spanning_tree_is_that_of_kruskal(spark):
    rng = random.Random(4)
    rows = [(i, j, rng.choice([0.5, 1.0, rng.random()])) for i in range(40) for j in rng.sample(range(40), 3)] + [(50, 51, 0.2)]
    nodes = spark.createDataFrame([(i,) for i in [*range(40), 50, 51, 60]], "i long")
    got = {(r.a, r.b, r.dist) for r in G.spanning_tree(spark.createDataFrame(rows, "i long, j long, dist double").repartition(3), nodes).collect()}
    least = {}
    for i, j, d in rows:
        if i != j:
            key = (min(i, j), max(i, j))
            least[key] = min(d, least.get(key, 9))
    root = {r.i: r.i for r in nodes.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for d, a, b in sorted((d, *k) for k, d in least.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, d))
    assert got == want


def test_bundles_and_selections(spark, tmp_path):
    from twinsieve.plans import benchmarks, subsets
    from twinsieve.sources import bundles

    rows = spark.range(6).select(F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("v"))
    folder = str(tmp_path / "features")
    assert not bundles.exists(spark, folder)
    bundles.write_features(folder, rows, rows, rows.select("i"), {"encoder": "x"})
    tables, facts = bundles.read(spark, folder, ["img", "meta"])
    assert facts == {"encoder": "x", "rows": 6} and tables["img"].count() == 6
    with pytest.raises(ValueError, match="same ids"):
        bundles.write_features(folder, rows, rows.where("i > 0"), rows.select("i"), {})
    again, _ = bundles.load_or_build(spark, folder, ["txt"], lambda: pytest.fail("built again"))
    assert again["txt"].count() == 6
    chosen = spark.createDataFrame([(1, 0), (3, 1), (1, 2)], "i long, rank int")
    assert [r.i for r in subsets.by_positions(rows, chosen).orderBy("rank").collect()] == [1, 3, 1]
    with pytest.raises(ValueError, match="twice"):
        subsets.validated(rows, chosen)
    assert subsets.records(rows, "random", percent=50).count() == 3
    files = spark.createDataFrame([("a/qwen_MMBench.xlsx",), ("a/qwen_MMBench_acc.xlsx",), ("b/summary.csv",), ("c/predictions_score.json",), ("x.txt",)], "f string")
    assert [r[0] for r in files.select(benchmarks.holds_scores(F.col("f"))).collect()] == [False, True, True, False, False]
    path = str(tmp_path / "excel")
    bundles.write_excel_csv(spark.createDataFrame([(1, 'a"b'), (2, None)], "n int, t string"), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text == '\ufeffsep=,\n"n","t"\n"1","a""b"\n"2",""\n'
