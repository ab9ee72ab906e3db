"""What several operators share: durable intermediate tables, row selection and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A local session that names none gets a local one; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talkweave-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Cuts lineage, keeps the result when an executor is lost, and computes costly
    or partition-dependent columns once."""
    path = f"{shared_dir(df.sparkSession)}/talkweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """name, or a longer one that no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs by name, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def record_key(*columns: Column) -> Column:
    """128 bits of the columns' texts; nulls are told from empty texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(*map(part, columns)).cast("binary")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join on key whose two sides both get an exchange of their own.

    Aggregated inputs are already dealt by key, which keeps adaptive execution from
    splitting a hot key. Joining on (hash, key) asks for a new deal of both sides, so
    skewed partitions of the left side are split at run time."""
    h = "__spread"
    a, b = left.withColumn(h, F.xxhash64(key)), right.withColumn(h, F.xxhash64(key))
    return a.join(b.hint("merge"), [h, key], how).drop(h)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step makes each
    node point to the smallest node in its neighbourhood, with edges only ever shrinking in
    number. Each round is a written table; it ends when the edge set stops changing. Nodes
    without edges are not returned. Hot stars are aggregated before the shuffle, and joins back
    to their leaves go through spread_join."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = spread_join(near, low, "a", "inner")
        if large:
            out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def summary(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    e = durable(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = summary(e)
    for _ in range(rounds):
        if not last[0]:
            break
        e = durable(star(star(e, True), False))
        now = summary(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.groupBy("b").agg(F.first("b").alias("component")).select(F.col("b").alias("node"), "component"))


def settled(result):
    """result, after freed memory has gone back to the system: workers serve many tasks, and are idle between."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
    return result
