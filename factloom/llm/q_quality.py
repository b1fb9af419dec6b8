"""Registered queries on quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import classifier, rules
from factloom.llm.common import table
from factloom.llm.registry import query

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op3_quality_rules", f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) AS lines FROM base
), grams AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM parts, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8
), again AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) AS o(k) GROUP BY r
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {_SPACES}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops, (length(t) - length(replace(t, '!!', ''))) / 2 AS shouts
  FROM parts LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 1.5 AND 15 AND n_symbols / greatest(word_chars, 1) <= 0.1 AND shouts / n <= 0.3
    AND stops / n >= 0.005 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM judged""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the model fitted on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score_documents(docs, model)
    return scored.select("_row.doc_id", classifier.held_out(F.col("_row.doc_id")).alias("held_out"), "score", "predicted")
