"""Registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.decontamination import contamination
from tessera.llm.line_dedup import line_dedup
from tessera.llm.lm_scoring import held_out, lm_scores
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack
from tessera.llm.quality_rules import LADDERS, quality_rules
from tessera.llm.secret_scan import dictionary, labelled_findings, secret_scan, train
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.warc import read_warc, write_warc


#: Of the quality rules: the share of clean documents that may go, and the probability that more do.
RISK, DELTA = 0.05, 0.05


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the folder is the installed package's own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), risk=RISK, delta=DELTA).drop("text_digest")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = materialise(dictionary(docs), "dictionary")
    found = secret_scan(docs, train(labelled_findings(spark, words), words), words)
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score", "is_secret", "times")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(path, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held=held_out("doc_id", 7, 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_secret_scan, op4_line_dedup, op5_suffix_array_dedup, op6_warc, op7_best_fit_packing, op8_token_files, op9_benchmark_decontamination, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_warc": OP6_SQL}


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.keep_id) AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), lead AS (
  SELECT html, max(page_id) AS leader FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN l.leader IS NOT NULL AND l.leader <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN l.leader <> p.page_id THEN l.leader END AS refers_to
FROM p LEFT JOIN lead l ON p.html = l.html
"""

_SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LADDER = ", ".join(f"('{rule}', {k}, {cut}::DOUBLE)" for k, (rule, cuts) in enumerate(LADDERS.items()) for cut in cuts)
_ALPHA = RISK / len(LADDERS)
OP2_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, {_SPACES})) > 0) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 7)) AS i FROM base WHERE len(ws) >= 8)
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id
), f AS (
  SELECT base.doc_id, s, len(ws) AS n_words, length(translate(t, {_SPACES}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '\pL+', '', 'g')) AS letters, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, length(t) - length(translate(t, '!?', '')) AS marks
  FROM base LEFT JOIN repeats ON repeats.doc_id = base.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), metrics AS (
  SELECT doc_id, s, base_failed, unnest([
    {{'rule': 'symbols', 'v': coalesce(n_symbols / nullif(n_words, 0), 0)}}, {{'rule': 'dup_lines', 'v': coalesce(n_dup_lines / nullif(n_lines, 0), 0)}},
    {{'rule': 'repeats', 'v': coalesce(n_repeat_words / nullif(n_words, 0), 0)}}, {{'rule': 'long_words', 'v': coalesce(word_chars / nullif(n_words, 0), 0)}},
    {{'rule': 'shouting', 'v': coalesce(capitals / nullif(letters, 0), 0)}}, {{'rule': 'marks', 'v': coalesce(marks / nullif(n_words, 0), 0)}}], recursive := true)
  FROM judged
), ladder(rule, rank, cut) AS (VALUES {_LADDER}
), marked AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), rungs AS (
  SELECT s, metrics.rule, cut, count(*) FILTER (WHERE q > 0) AS n, count(*) FILTER (WHERE q > 0 AND v > cut) AS k, count(*) FILTER (WHERE q <= 0 AND v > cut) AS caught
  FROM metrics JOIN marked USING (doc_id) JOIN ladder ON ladder.rule = metrics.rule WHERE NOT base_failed GROUP BY ALL
), tested AS (
  SELECT *, n > 0 AND k <= n * {_ALPHA} AND k < n AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_ALPHA}) + (n - j) * ln(1 - {_ALPHA}))) FROM range(0, k + 1) r(j)
  ) <= {DELTA} / (SELECT count(DISTINCT (s, rule)) FROM rungs) AS ok
  FROM rungs
), certified AS (
  SELECT * FROM (SELECT *, min(ok::INTEGER) OVER (PARTITION BY s, rule ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS all_ok FROM tested) WHERE all_ok = 1
), cutoffs AS (
  SELECT s, rule, arg_max(cut, {{'gain': caught - k, 'cut': cut}}) AS cut FROM certified GROUP BY s, rule
), failures AS (
  SELECT metrics.doc_id, string_agg(metrics.rule, ',' ORDER BY rank) AS failed_rules
  FROM metrics JOIN cutoffs ON cutoffs.s = metrics.s AND cutoffs.rule = metrics.rule JOIN (SELECT DISTINCT rule, rank FROM ladder) o ON o.rule = metrics.rule
  WHERE v > cutoffs.cut GROUP BY metrics.doc_id
)
SELECT judged.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM judged LEFT JOIN failures ON failures.doc_id = judged.doc_id
"""
