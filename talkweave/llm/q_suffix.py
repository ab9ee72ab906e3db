"""op2: removes repeated passages from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.suffix_dedup import repeated_passages


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("kept_sha256",))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window as hexadecimal text with the smallest id that has it, then the runs of covered bytes.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)
), hit AS (
  SELECT r, p FROM (SELECT r, p, id, min(id) OVER (PARTITION BY s) AS low FROM w) WHERE low < id
), run AS (
  SELECT r, p, sum(CASE WHEN p <= b + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS b FROM hit)
), span AS (
  SELECT r, min(p) AS s, max(p) + 50 AS e FROM run GROUP BY r, k
), cut AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a FROM span
), part AS (
  SELECT r, a, s AS b FROM cut UNION ALL SELECT d.r, coalesce(m.e, 0), length(h) // 2 FROM d LEFT JOIN (SELECT r, max(e) AS e FROM span GROUP BY r) m ON m.r = d.r
), kept AS (
  SELECT d.r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM d JOIN part ON part.r = d.r GROUP BY d.r
), total AS (
  SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN total ON total.r = d.r
"""

QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE = {"op2_suffix_dedup": SQL}
