"""op12: product codes of all embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.vector_codes import books_digest, compress


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """The nearest entry e and squared distance d of each part of each row under codebook b<k>; doubles hold them exactly."""
    return f"""a{k} AS MATERIALIZED (
  SELECT part, r, min(d * 256 + e) % 256 AS e, min(d) AS d FROM (
    SELECT p.part, p.r, b.e, CAST(p.xx - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) AS d FROM parts p JOIN b{k} b ON p.part = b.part
  ) GROUP BY part, r
)"""


def _moved(k: int) -> str:
    """Codebook b<k + 1>: floors of the means; (n + s % n) % n is the floor's remainder."""
    return f"""b{k + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(y, x) AS x FROM b{k} LEFT JOIN (
    SELECT part, e, list(((s - (n + s % n) % n) // n)::DOUBLE ORDER BY i) AS y FROM (
      SELECT part, e, i, sum(v::BIGINT) AS s, count(*) AS n FROM (
        SELECT a.part, a.e, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS v FROM a{k} a JOIN parts p USING (part, r)
      ) GROUP BY part, e, i
    ) GROUP BY part, e
  ) USING (part, e)
)"""


_ROUNDS = ",\n".join([f"{_round(k)},\n{_moved(k)}" for k in range(4)] + [_round(4)])

SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding::DOUBLE[], lambda c: floor(c * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: abs(c) >= sqrt(power(2.0::DOUBLE, 50) * 4 / len(embedding)) / 1024)) = 0
), w AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS place FROM v
), parts AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx FROM (SELECT r, place, part, list_slice(v, 1 + part * len(v) // 4, (part + 1) * len(v) // 4) AS x FROM w, (SELECT unnest(range(4)) AS part))
), b0 AS MATERIALIZED (
  SELECT part, place AS e, x FROM parts WHERE place < 256
), {_ROUNDS}, digest AS (
  SELECT sha256(string_agg(array_to_string(x::BIGINT[], ','), ',' ORDER BY part, e)) AS h FROM b4
), done AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM w JOIN done USING (r)
"""

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {"op12_vector_codes": SQL}
