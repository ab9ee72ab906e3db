"""op7: licences of all documents, and their SQL.

The documents have no paths, so the query gives each a place in a tree: the source, then two levels of id
ranges. A document that speaks of a licence is its directory's licence file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.license_scan import TEMPLATES, TITLES, scan

SPEAKS = "(?i)(licensed|released) under"
PATH = f"""
concat('/', source, '/', floor(doc_id / 1000), '/', floor(doc_id / 100), '/', CASE WHEN text RLIKE '{SPEAKS}' THEN 'LICENSE' ELSE concat(doc_id, '.txt') END)
"""


def place() -> Column:
    return F.expr(PATH)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", place()))


_LITERALS = ",\n".join(f"({k}, '{name}', '{text}', {str(k >= len(TEMPLATES)).lower()})" for k, (name, text) in enumerate(sorted(TEMPLATES) + sorted(TITLES)))
SQL = rf"""
WITH tpl(k, name, body, title) AS (VALUES {_LITERALS}),
tok AS (
  SELECT k, w, count(*) AS tf FROM (SELECT k, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS w FROM tpl) WHERE w <> '' GROUP BY k, w
), vocab AS (
  SELECT list(DISTINCT w) FILTER (NOT title) AS words, list(DISTINCT w) AS every FROM tok JOIN tpl USING (k)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    '/' || source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || CASE WHEN regexp_matches(text, '{SPEAKS}') THEN 'LICENSE' ELSE doc_id || '.txt' END AS path
  FROM documents
), s AS (
  SELECT r, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT r, string_split(t, chr(10)) AS l FROM d)
), full_line AS (
  SELECT r, i, x FROM (SELECT r, i, list_filter(regexp_split_to_array(lower(l[i]), '[^a-z0-9]+'), lambda x: x <> '') AS x FROM s) WHERE len(x) > 0
), line AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) AS spot, x, 2 * len(list_intersect(list_distinct(x), words)) >= len(list_distinct(x)) AS near FROM full_line, vocab
), seg AS (
  SELECT r, 0 AS kind, spot, x FROM line WHERE near
  UNION ALL SELECT r, 1, spot - row_number() OVER (PARTITION BY r ORDER BY spot), x FROM line WHERE near
  UNION ALL SELECT line.r, kind, nth, x FROM line JOIN d ON d.r = line.r, (VALUES (2, 0, 1000000000), (3, 1, 1), (3, 2, 2)) AS w(kind, nth, most) WHERE path LIKE '%/LICENSE' AND line.spot <= most
), tf AS (
  SELECT r, kind, spot, w, count(*) AS tf FROM (SELECT r, kind, spot, unnest(x) AS w FROM seg) GROUP BY ALL
), total AS (
  SELECT count(*) AS lines FROM line
), q AS (
  SELECT v.w, power(ln((lines + 1) / (coalesce(df, 0) + 1)) + 1, 2) AS q
  FROM (SELECT unnest(every) AS w FROM vocab) v CROSS JOIN total LEFT JOIN (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(x)) AS w FROM line) GROUP BY w) f ON f.w = v.w
), norm AS (
  SELECT k, sqrt(sum(q * tf * tf)) AS norm FROM tok JOIN q USING (w) GROUP BY k
), own AS (
  SELECT r, kind, spot, sqrt(sum(tf * tf * coalesce(q, power(ln(lines + 1.0) + 1, 2)))) AS size FROM tf CROSS JOIN total LEFT JOIN q USING (w) GROUP BY r, kind, spot
), cosine AS (
  SELECT own.r, own.kind, own.spot, tok.k, round(sum(tf.tf * tok.tf * q) / (size * norm), 4) AS score
  FROM own JOIN tf USING (r, kind, spot) JOIN tok USING (w) JOIN q USING (w) JOIN norm ON norm.k = tok.k JOIN tpl ON tpl.k = tok.k WHERE title = (own.kind = 3) GROUP BY own.r, own.kind, own.spot, tok.k, size, norm
), best AS (
  SELECT r, k, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY kind DESC, score DESC, k) AS o FROM cosine WHERE score >= CASE WHEN kind = 3 THEN 0.9 ELSE 0.6 END) WHERE o = 1
), f AS (
  SELECT d.r, doc_id, path, k, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d LEFT JOIN best ON best.r = d.r
), holder AS (
  SELECT dir, k FROM (SELECT dir, k, row_number() OVER (PARTITION BY dir ORDER BY score DESC, k) AS o FROM f WHERE path LIKE '%/LICENSE' AND k IS NOT NULL) WHERE o = 1
), above AS (
  SELECT r, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') AS dir
  FROM (SELECT r, dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM f WHERE k IS NULL AND path IS NOT NULL)
), up AS (
  SELECT r, dir, k FROM (SELECT r, above.dir, holder.k, row_number() OVER (PARTITION BY r ORDER BY depth DESC) AS o FROM above JOIN holder ON holder.dir = above.dir) WHERE o = 1
)
SELECT doc_id, path, t1.name AS own_license, f.score AS own_score, t2.name AS license, up.dir AS inherited_from
FROM f LEFT JOIN up ON up.r = f.r LEFT JOIN tpl t1 ON t1.k = f.k LEFT JOIN tpl t2 ON t2.k = coalesce(f.k, up.k)
"""

QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE = {"op7_license_scan": SQL}
