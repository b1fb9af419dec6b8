"""Registered query on benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import leaks
from factloom.llm.common import table
from factloom.llm.registry import query

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op13_benchmark_leaks", f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM b, unnest(range(1, len(w) - m + 2)) AS u(i)
), flat AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), runs AS (
  SELECT r, i, n, [x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 10))}] AS x FROM flat WINDOW o AS (PARTITION BY r ORDER BY i)
), met AS (
  SELECT r, i, s.m, array_to_string(x[1 : s.m], ' ') AS g FROM runs JOIN (SELECT DISTINCT m FROM b) s ON i + s.m - 1 <= n
), hits AS MATERIALIZED (
  SELECT r, i, met.m, item_id FROM met JOIN windows USING (m, g)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(m)) AS u(k) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""")
def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items whose windows occur."""
    found = leaks.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
