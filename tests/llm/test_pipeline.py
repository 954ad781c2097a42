import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups
from twinsieve.llm import fm_quality
from twinsieve.llm.surrogates import PATTERN


def test_stages(spark, sf_dir):
    import regex

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "line_dedup", "ngram_jaccard", "pii_surrogates", "best_fit_packing"]
    texts = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = f(spark, docs, sf_dir)
        assert out.columns == columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        texts[name] = {r.doc_id: r.text for r in rows}
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_classifier":
            kept = {r.doc_id for r in fm_quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("predicted = 1").collect()}
            assert set(texts[name]) == kept and all(before[i] == t for i, t in texts[name].items())
        elif name == "line_dedup":
            want = brute_lines(sorted(before.items()))
            assert texts[name] == {i: t for i, t in want if t == before[i] or t.split()}
        elif name == "ngram_jaccard":
            groups = brute_groups(sorted(before.items()))
            assert texts[name] == {i: before[i] for i, (_, c) in groups.items() if i == c}
        else:
            assert set(texts[name]) == set(before)
            found = regex.compile(PATTERN.replace("(?U:\\b)", "").replace("(?i:", "(?i:"))
            assert all((t != before[i]) == bool(found.search(before[i])) for i, t in texts[name].items())
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts["pii_surrogates"].items()}
