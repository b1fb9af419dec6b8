"""Registered queries on duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import repeats, simhash, vectors
from factloom.llm.common import table
from factloom.llm.registry import query


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_multi_index", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), named AS (
  SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), counted AS (
  SELECT a AS r, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN named USING (r) LEFT JOIN counted USING (r)""")
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels."""
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_suffix_repeats")
def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings; ``kept_text`` shows bytes of a split character as U+FFFD."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))

