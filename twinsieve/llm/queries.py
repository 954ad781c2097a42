"""The queries opN_<name> and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fm_quality, html_text, line_dedup, media, ngram_quality, packing, surrogates, token_files
from .common import table
from .ngram_join import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Fixed value: the end-of-text id of word_bpe_49k.json.
END_OF_TEXT = 49407
#: A production job takes its own from where it keeps secrets.
SURROGATE_KEY = "surrogates of the test tables"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return out.select("doc_id", F.col("_entities").alias("n_entities"), "text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_token_counts(table(spark, sf_dir, "documents"), WORD_BPE, END_OF_TEXT).select("doc_id", "n_tokens")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    ops = (op1_html_extraction, op2_ngram_jaccard, op3_best_fit_packing, op4_line_dedup, op5_pii_surrogates, op6_byte_bpe, op7_token_counts, op8_quality_classifier, op9_quality_rules, op10_media_columns)
    return {f.__name__: f for f in ops}


#: Lines of the whole table against each other: equal ones by their text; near ones by characters, or by words, of which
#: each is one character by hash, in four ways: a distance by hashes is never greater, and a word changed for
#: one of the same character in all four is the only way to be less.
_OP4 = r"""
WITH pieces AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lines AS (
  SELECT doc_id, pos, line, lower(trim(line, ' ' || chr(9) || chr(13))) AS norm FROM pieces
), classes AS (
  SELECT norm, string_split_regex(norm, '[ \t\r]+') AS w, min({'doc_id': doc_id, 'pos': pos}) AS first
  FROM lines WHERE length(norm) >= 24 OR regexp_matches(norm, '[\p{L}\p{N}]') GROUP BY norm
), long AS (
  SELECT norm, first, len(w) >= 8 AS by_word, CASE WHEN len(w) >= 8 THEN len(w) ELSE length(norm) END AS n,
    CODES
  FROM classes WHERE len(w) >= 8 OR length(norm) >= 24
), sides AS (
  SELECT *, n + d AS m FROM long, (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) AS t(d) WHERE by_word OR abs(d) <= 1
), pairs AS (
  SELECT y.norm AS yn, x.norm AS xn, y.by_word, CASE WHEN NOT y.by_word OR least(x.n, y.n) < 18 THEN 1 WHEN least(x.n, y.n) < 32 THEN 2 ELSE 3 END AS t, y.d,
    XS
  FROM sides y JOIN long x ON x.n = y.m AND x.by_word = y.by_word WHERE x.first < y.first
), near AS (
  SELECT DISTINCT yn AS norm FROM pairs WHERE abs(d) <= t AND CASE WHEN by_word THEN TESTS ELSE levenshtein(xn, yn) <= 1 END
), judged AS (
  SELECT l.doc_id, l.pos, l.line,
    c.norm IS NOT NULL AND (c.first <> {'doc_id': l.doc_id, 'pos': l.pos} OR l.norm IN (SELECT norm FROM near)) AS gone
  FROM lines l LEFT JOIN classes c ON c.norm = l.norm
), rebuilt AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL WHEN r.doc_id IS NULL THEN sha256(d.text) ELSE sha256(r.text) END AS text_sha256
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
_OP4 = _OP4.replace("CODES", ", ".join(f"list_reduce(list_prepend('', list_transform(w, lambda x: chr((33 + hash('{k}' || x) % 90)::INTEGER))), lambda a, b: a || b) AS c{k}" for k in range(4)))
_OP4 = _OP4.replace("XS", ", ".join(f"x.c{k} AS x{k}, y.c{k} AS y{k}" for k in range(4))).replace("TESTS", " AND ".join(f"levenshtein(x{k}, y{k}) <= t" for k in range(4)))


#: Sets of runs of five words, all pairs that share one, and what their links reach.
_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM words
), elements AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM reach r JOIN both_ways l ON l.x = r.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT x, min(c) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _OP2, "op4_line_dedup": _OP4}
