"""Registered queries on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import warc
from factloom.llm.common import table
from factloom.llm.registry import query

_DIGITS = ", ".join(f"('0x' || substr(h, {5 * i + 1}, 5))::INT" for i in range(8))


@query("op6_warc", f"""
WITH given AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT *, sha1(html) AS h FROM given
), coded AS (
  SELECT *, array_to_string(list_transform([{_DIGITS}], lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS d,
    max(page_id) OVER (PARTITION BY html) AS last FROM hashed
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM coded""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back by verified boundaries."""
    files = warc.write_warc(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.described(warc.read_warc(files))
