"""Source divergence audit: how far the term shares of the sources of a language lie apart, by DuckDB over shards.

Terms are counted by DuckDB inside the tasks, over Arrow tables of bounded size; Spark adds the counts up, and deals them
to shards by language and a hash of the term. In each shard DuckDB keeps the frequent terms, and once the totals of
all groups are known computes the smoothed shares, the partial sums of pairs of sources, and each group's first terms.
Spark merges sums and rankings.

A share is 1 + floor(unit * (count + add) / (N + add * V)), with V the kept terms of the language and N the counts of the
group. Groups lack most terms, so pairs are never compared term by term where one of both lacks it: with z the share of
a count of zero, W the kept terms that a group has,

  sum |p - q| = sum over shared terms (|p - q| - |p - z_q| - |z_p - q| + |z_p - z_q|)
              + sum over p's terms |p - z_q| + sum over q's terms |z_p - q| + (V - W_p - W_q) |z_p - z_q|.

The first sum is made in the shards; the next two need only how often each group has each share, which the shards
count. All numbers are whole and exact.

Hot groups: counts are aggregated before every shuffle, a language is dealt to many shards, and its pairs to many salts.
A shard holds about `shard_rows` counts of (source, term). The result has one row for each ordered pair of sources of
a language, which is what is asked for.

Defined results: a null text, language or source is an empty one; a group without terms, or in a language without kept
terms, has all its pairs (distance 0 where no term is kept) and no terms; rows that repeat count each; a language of one source has no
pairs; ties are ordered by the item's bytes; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.common import durable, settled, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

COUNTS = f"""
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM (
  SELECT r, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM texts
  ) GROUP BY r, term
) GROUP BY lang, source, term
"""

KEPT = """
SELECT source, term, n, row_number() OVER (PARTITION BY term ORDER BY source) = 1 AS leads FROM (
  SELECT source, term, n, sum(docs) OVER (PARTITION BY term) AS docs FROM counts
) WHERE docs >= {least}
"""

SHARES = """
CREATE OR REPLACE TEMP TABLE shares AS
SELECT source, term, (1 + {unit}::HUGEINT * (n + {add}) // total)::BIGINT AS p, (1 + {unit}::HUGEINT * {add} // total)::BIGINT AS z,
       (1 + {unit}::HUGEINT * (sum(n) OVER (PARTITION BY term) + {add}) // lang_total)::BIGINT AS q FROM counts
"""

SUMS = """
SELECT 'shared' AS kind, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))::BIGINT AS value, 0::BIGINT AS n
FROM shares a JOIN shares b ON a.term = b.term AND a.source < b.source GROUP BY a.source, b.source
UNION ALL
SELECT 'share', source, '', p, count(*) FROM shares GROUP BY source, p
UNION ALL
SELECT 'term', source, term, p - q, 0 FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= {top}
"""


def database():
    """A DuckDB of this task's own, in memory and on one thread; it never spills to the machine's disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk_bytes: int = 1 << 24) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it): partial counts, several rows for a key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, held, size = database(), [], 0

        def told() -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            db.register("texts", t.append_column("r", pa.array(range(t.num_rows), pa.int64())))
            out = db.sql(COUNTS).to_arrow_table().to_batches(max_chunksize=1 << 16)
            db.unregister("texts")
            return out

        for b in batches:
            ends = pc.cumulative_sum(pc.cast(pc.binary_length(b.column(0)), pa.int64())).to_numpy()
            at = 0
            while at < b.num_rows:  # rows until the chunk is full, one at least
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(ends.searchsorted(before + chunk_bytes - size, side="right")))
                held.append(b.slice(at, end - at))
                size += int(ends[end - 1] - before)
                at = end
                if size >= chunk_bytes or at < b.num_rows:
                    yield from told()
                    held, size = [], 0
                    settled(None)
        if held:
            yield from told()
        db.close()
        settled(None)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    return d.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def in_shards(d: DataFrame, columns: list[str], statements: list[str], schema: str) -> DataFrame:
    """The rows of the last statement over each shard's rows (table counts), with lang and shard before them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        db = database()
        db.register("counts", table.select(columns))
        for s in statements[:-1]:
            db.execute(s)
        out = db.sql(statements[-1]).to_arrow_table()
        db.close()
        for k, name in enumerate(("lang", "shard")):
            out = out.add_column(k, name, pa.array([key[k].as_py()] * out.num_rows, key[k].type))
        return settled(out)

    return d.groupBy("lang", "shard").applyInArrow(run, f"lang string, shard int, {schema}")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, add: int = 5, unit: int = 1_000_000_000, top: int = 50, shard_rows: int = 400_000, salt_groups: int = 64) -> DataFrame:
    """lang, source, part ("pair": item is another source of the language; "term": item is a term that is commoner in the
    group than in its language, the first `top`), item, value (the distance), rank (from 1 in each group and part)."""
    counts = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = durable(counts)
    shards = max(1, math.ceil(counts.count() / shard_rows))
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    kept = durable(in_shards(dealt, ["source", "term", "n", "docs"], [KEPT.format(least=least_docs)], "source string, term string, n long, leads boolean"))

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("w"), F.sum(F.col("leads").cast("long")).alias("v"))
    all_ = own.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    groups = groups.join(own.drop("v"), ["lang", "source"], "left").join(all_, "lang", "left").na.fill(0, ["n", "w", "v", "lang_n"])
    groups = groups.withColumns({"total": F.col("n") + add * F.col("v"), "lang_total": F.col("lang_n") + add * F.col("v")})
    zero = F.when(F.col("v") > 0, 1 + F.floor(F.lit(unit * add) / F.greatest("total", F.lit(1)).cast("decimal(20,0)")).cast("long")).otherwise(F.lit(0).cast("long"))
    groups = durable(groups.select("lang", "source", "w", "v", "total", "lang_total", zero.alias("z")))

    named = kept.withColumn("own", F.struct("lang", "source"))
    known = groups.select(F.struct("lang", "source").alias("own"), "total", "lang_total")
    shares = [SHARES.format(unit=unit, add=add), SUMS.format(top=top)]
    sums = durable(in_shards(spread_join(named, known, "own", "inner"), ["source", "term", "n", "total", "lang_total"], shares, "kind string, source string, item string, value long, n long"))

    found = pair_sums(groups, sums, salt_groups)
    pairs = found.select("lang", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))).alias("p"), "value")
    pairs = ranked(pairs.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value"))
    terms = ranked(sums.filter("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value")).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def pair_sums(groups: DataFrame, sums: DataFrame, salt_groups: int) -> DataFrame:
    """lang, low, high (sources, low < high), value: all pairs of sources of each language."""
    shares = sums.filter("kind = 'share'").groupBy("lang", "source", "value").agg(F.sum("n").alias("n"))
    shares = shares.groupBy("lang", "source").agg(F.collect_list(F.struct("value", "n")).alias("shares"))
    salts = max(1, math.ceil(groups.count() / salt_groups))
    a = groups.join(shares, ["lang", "source"], "left").select("lang", F.col("source").alias("a"), "shares", F.col("w").alias("wa"), F.col("z").alias("za"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("w").alias("wb"), F.col("z").alias("zb"), "v", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int").alias("salt"))
    far = F.coalesce(F.aggregate("shares", F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.abs(x["value"] - F.col("zb"))), F.lit(0))
    neither = F.when(F.col("a") < F.col("b"), (F.col("v") - F.col("wa") - F.col("wb")) * F.abs(F.col("za") - F.col("zb"))).otherwise(0)
    apart = a.join(b, ["lang", "salt"]).filter("a != b").select("lang", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (far + neither).alias("value"))
    shared = sums.filter("kind = 'shared'").select("lang", F.col("source").alias("low"), F.col("item").alias("high"), "value")
    return apart.unionByName(shared).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def ranked(d: DataFrame) -> DataFrame:
    """rank: from 1 in each group and part, by value descending, then by the item's bytes."""
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
