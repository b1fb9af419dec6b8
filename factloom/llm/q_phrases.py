"""Registered query on collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import phrases
from factloom.llm.common import table
from factloom.llm.registry import query


@query("op12_collocations", """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[: -2], w[2 :]), lambda x: x[1] || ' ' || x[2])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[: -3], w[2 : -2], w[3 :]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) FROM w WHERE len(w) > 2
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, l.a AS l, r.a AS r, (1000000 * c.a * c.a) // (l.a * r.a) AS score
  FROM cand c, range(1, 3) AS u(cut), f l, f r
  WHERE cut < c.k AND l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 :], ' ')
), scored AS MATERIALIZED (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[1 : 2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM cand WHERE k = 3
  ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, s.a DESC, encode(phrase)) AS rank, phrase, s.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM scored s LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100 * most < 50 * s.a
QUALIFY rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of every language, by the association of their parts."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
