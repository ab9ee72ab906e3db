"""op11: rules and host reputations over all pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.url_filter import LOWER, TWO_LABELS, UPPER, judge

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes that reputations learn from are those of the rules."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_CASES = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
_NAMES = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _CASES)
_VERDICTS = " ".join(f"WHEN {_fits(r)} THEN '{v}'" for r, v in _CASES)
_TWO = ", ".join(f"'{t}'" for t in TWO_LABELS)


def _rho(groups: str) -> str:
    return f"""(SELECT 1 / (CASE WHEN coalesce(b, 0) = 0 THEN 0.5::DOUBLE ELSE least(greatest(a / b, 0.001::DOUBLE), 0.999::DOUBLE) END) - 1 FROM
    (SELECT sum((k - n * m) * (k - n * m) - n * m * (1 - m)) AS a, sum(n * (n - 1) * m * (1 - m)) AS b FROM {groups} WHERE n > 1))"""


SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), t AS (
  SELECT page_id, host, path, CASE {_NAMES} END AS rule, CASE {_VERDICTS} END AS told FROM p
), hosts AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS bare,
         count(told)::DOUBLE AS n, (count(*) FILTER (told = 'allow'))::DOUBLE AS k FROM t GROUP BY host
), parts AS (
  SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[^.]*$|^[0-9.]+$|^\[') AS plain FROM hosts
), sized AS (
  SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN 2 ELSE 1 END AS s FROM parts
), named AS MATERIALIZED (
  SELECT host, n, k, CASE WHEN plain THEN bare ELSE array_to_string(l[-(s + 1):], '.') END AS dom,
         CASE WHEN plain THEN bare ELSE array_to_string(l[-s:], '.') END AS suf FROM sized
), s0 AS MATERIALIZED (
  SELECT suf, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM named) AS m FROM named GROUP BY suf
), s1 AS (
  SELECT suf, (k + {_rho('s0')} * m) / (n + {_rho('s0')}) AS m FROM s0
), d0 AS MATERIALIZED (
  SELECT dom, sum(n) AS n, sum(k) AS k, any_value(s1.m) AS m FROM named JOIN s1 USING (suf) GROUP BY dom
), d1 AS (
  SELECT dom, n AS labelled, (k + {_rho('d0')} * m) / (n + {_rho('d0')}) AS m FROM d0
), h0 AS MATERIALIZED (
  SELECT host, n, k, labelled, d1.m FROM named JOIN d1 USING (dom)
), h1 AS (
  SELECT host, labelled, (k + s * m) / (n + s) AS r, n + s AS size FROM (SELECT *, {_rho('h0')} AS s FROM h0)
)
SELECT page_id, host, path, rule,
       coalesce(told, CASE WHEN labelled > 0 AND r + 1.28 * sqrt(r * (1 - r) / (size + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN h1 USING (host)
"""

QUERIES = {"op11_url_filter": op11_url_filter}
ORACLE = {"op11_url_filter": SQL}
