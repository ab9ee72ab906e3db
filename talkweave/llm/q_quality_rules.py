"""op1: quality rules over all documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.quality_rules import assess


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, p, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM s)
), spots AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM spots) GROUP BY r
), each AS (
  SELECT r, unnest(range(1, len(ls) + 1)) AS pos, host, ls FROM s
), line AS (
  SELECT r, pos, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS n,
         ('0x' || substr(md5(CASE WHEN host IS NULL THEN '' ELSE 'h' || host END || chr(10) ||
            array_to_string(regexp_extract_all(lower(ls[pos]), '[^\x20\x09-\x0D]+'), ' ')), 1, 15))::BIGINT AS k
  FROM each
), uniq AS (
  SELECT DISTINCT r, k FROM line
), doc AS (
  SELECT r, md5(string_agg(k::VARCHAR, ',' ORDER BY pos)) AS f FROM line GROUP BY r
), freq AS (
  SELECT k FROM uniq JOIN doc USING (r) GROUP BY k HAVING count(DISTINCT f) > 10
), gone AS (
  SELECT r, count(*) AS n_lines, sum(n)::BIGINT AS n_words FROM line WHERE k IN (SELECT k FROM freq) GROUP BY r
), base AS (
  SELECT s.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN rep ON rep.r = s.r
), verdict AS (
  SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, v.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(g.n_lines, 0) > 0 AND (v.n_words - g.n_words < 10 OR 100 * (v.n_words - g.n_words) < 30 * v.n_words)) AS kept,
       coalesce(g.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(g.n_words, 0)::BIGINT AS n_removed_words
FROM verdict v LEFT JOIN gone g ON g.r = v.r
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE = {"op1_quality_rules": SQL}
