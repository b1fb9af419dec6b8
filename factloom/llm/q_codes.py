"""Registered query on vector codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import codes
from factloom.llm.common import table
from factloom.llm.registry import query


def _round(k: int) -> str:
    """Assignment to the entries of b{k} and the moved entries b{k + 1}."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, p, min(list_sum(list_transform(list_zip(parts.x, b{k}.x), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT)) * 256 + e) AS m
  FROM parts JOIN b{k} USING (p) GROUP BY r, p
), b{k + 1} AS MATERIALIZED (
  SELECT p, e, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS x FROM (
      SELECT p, (m % 256)::INT AS e, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
      FROM parts JOIN a{k} USING (r, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
    ) GROUP BY p, e
  ) m USING (p, e)
),"""


@query("op11_vector_codes", f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p::INT AS p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM v, range(8) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, e::INT AS e, x FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v QUALIFY e < 16) USING (r)
),{"".join(_round(k) for k in range(7))}
coded AS (
  SELECT r, string_agg(format('{{:02x}}', (m % 256)::INT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a6 GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM v JOIN coded USING (r)""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector, its error and its label's, and the digest of the codebooks."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))
