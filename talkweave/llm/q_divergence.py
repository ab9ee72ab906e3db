"""op13: the divergence of the sources of each language, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.divergence import LOWER, TERM, UPPER, audit


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), o AS (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d
  ) GROUP BY r, lang, source, term
), k AS MATERIALIZED (
  SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING count(*) >= 30
), c AS (
  SELECT lang, source, term, sum(o.n) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
         1 + 1000000000::HUGEINT * (lang_n + 5) // (sum(lang_n) OVER w + 5 * count(*) OVER w) AS q
  FROM f WINDOW w AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM e
QUALIFY part = 'pair' OR rank <= 50
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE = {"op13_source_divergence": SQL}
