"""Which source files to read again: a table of (path, mtime) beside the ingested data."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions.text import shard_id

# Database files by what they hold.
CATEGORIES = {"contact": r"/contact/", "session": r"/session/", "message": r"/message/message_[0-9]+\.db$", "index": r"_fts\.db$", "resource": r"/message/message_resource\.db$", "hardlink": r"/hardlink/", "media": r"/media(_[0-9]+)?\.db$"}
CORE = ("contact", "session")


def category(path: Column) -> Column:
    c = None
    for name, pattern in CATEGORIES.items():
        c = F.when(path.rlike(pattern), name) if c is None else c.when(path.rlike(pattern), name)
    return c.otherwise("other")


def listing(files: DataFrame) -> DataFrame:
    """(path, mtime, category, shard_id) of a file listing."""
    return files.select("path", F.col("modificationTime").alias("mtime"), category(F.col("path")).alias("category"), shard_id(F.col("path")).alias("shard_id"))


def in_scope(files: DataFrame, scope: str = "all", categories: list[str] | None = None, shards: list[int] | None = None) -> DataFrame:
    """all files; the core ones; some categories; or some message shards with the core files."""
    if scope == "all":
        return files
    if scope == "core":
        return files.filter(F.col("category").isin(*CORE))
    if scope == "categories":
        return files.filter(F.col("category").isin(categories or []))
    if scope == "shards":
        return files.filter(F.col("category").isin(*CORE) | ((F.col("category") == "message") & F.col("shard_id").isin(shards or [])))
    raise ValueError(f"unknown scope {scope}")


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that were not ingested with the modification time that they have."""
    return files.join(seen.select("path", "mtime"), ["path", "mtime"], "left_anti")


def stats(files: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: ingested, skipped and errors. failed: (path)."""
    d = files.join(seen.select("path", "mtime", F.lit(True).alias("old")), ["path", "mtime"], "left").join(failed.select("path", F.lit(True).alias("bad")).distinct(), "path", "left")
    old, bad = F.coalesce("old", F.lit(False)), F.coalesce("bad", F.lit(False))
    return d.agg(F.count_if(~old & ~bad).alias("ingested"), F.count_if(old).alias("skipped"), F.count_if(~old & bad).alias("errors"))


def after_ingest(files: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """The next table of seen files. Failed ones stay out and are tried again; if all fail, that is an error."""
    todo = changed(files, seen).select("path", "mtime")
    done = todo.join(failed.select("path").distinct(), "path", "left_anti")
    n, ok = todo.count(), done.count()
    if n and not ok:
        raise OSError("no source file could be read")
    return seen.select("path", "mtime").join(done.select("path"), "path", "left_anti").unionByName(done)


def write_ranges(ranges: DataFrame, path: str) -> None:
    """Shard ranges (shard_id, start_time, end_time) beside the data, as a version of their own: readers take the latest that is whole."""
    ranges.withColumn("version", F.lit(time.time_ns())).coalesce(1).write.mode("append").json(path)  # one row for each shard


def read_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    """Shard ranges, None if they are missing or damaged."""
    try:
        d = spark.read.schema("shard_id long, start_time long, end_time long, version long").option("mode", "FAILFAST").json(path)
        d = d.filter(F.col("version") == d.agg(F.max("version")).first()[0]).drop("version")
    except Exception:  # noqa: BLE001  any error means that there are none
        return None
    return d


def routed(ranges: DataFrame | None, since: int | None, until: int | None, last_activity: int | None) -> list[int] | None:
    """Shards that a time range needs; None for all: without bounds, without ranges, or where nothing is saved.

    The upper bound is the conversation's last activity if none is given. One row for each shard reaches the driver."""
    if ranges is None or since is None and until is None or until is None and last_activity is None:
        return None
    low, high = since or 0, until if until is not None else last_activity
    found = ranges.select("shard_id", ((F.col("start_time") <= high) & (F.col("end_time") >= low)).alias("meets")).collect()
    need = [r.shard_id for r in found if r.meets]
    return need if 0 < len(need) < len(found) else None
