"""Ingest that runs again and again: files that are new or changed are read, all others stay as they are.

Below a folder of its own there are the rows of each version, and a manifest of each version: path, mtime and log_mtime of
the file as it was read, its status, and the version that holds its rows. A version is committed by its manifest, one
file, so readers see all of a version or none of it, and a step that was lost is done again under the same number.

A file is read again when its own time or that of its log has changed. A damaged file is remembered with both times and not
tried again until one changes, and its earlier rows stay; a file that could not be reached is tried again each time;
where not one file can be read, that is an error. Files that are gone take their rows with them."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.sources import sqlite_source as Q
from talkweave.sources.sqlite_files import NUMBERED

MANIFEST = "path string, mtime timestamp, log_mtime timestamp, status string, held int, version int"


def listing(spark: SparkSession, root: str, pattern: str = NUMBERED) -> DataFrame:
    """(path, mtime, log_mtime, length) of the files below root; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    logs = d.filter(F.col("path").endswith(Q.LOG)).select(F.expr(f"left(path, length(path) - {len(Q.LOG)})").alias("path"), F.col("modificationTime").alias("log_mtime"))
    own = d.filter(F.col("path").rlike(pattern)).withColumnRenamed("modificationTime", "mtime")
    return own.join(logs, "path", "left").select("path", "mtime", "log_mtime", "length")


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """The latest version's files; none before the first."""
    try:
        d = spark.read.parquet(f"{at}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    last = d.agg(F.max("version")).first()[0]
    return d.filter(F.col("version") == last).select(*(c.split()[0] for c in MANIFEST.split(", ")))


def step(spark: SparkSession, root: str, at: str) -> dict[str, int]:
    """One pass over the message shards below root: how many files were ingested, skipped, and could not be read.

    The driver gets one row for each file, never rows of files."""
    seen = manifest(spark, at).collect()
    old = {r.path: r for r in seen}
    files = listing(spark, root).collect()
    todo = [r for r in files if r.path not in old or (r.mtime, r.log_mtime) != (old[r.path].mtime, old[r.path].log_mtime)]
    gone = old.keys() - {r.path for r in files}
    if not todo and not gone:
        return {"ingested": 0, "skipped": len(files), "errors": 0}
    version = 1 + max((r.version for r in seen), default=0)
    bad: dict[str, str] = {}
    if todo:
        rows = Q.raw_messages(spark, root, files=json.dumps([(r.path, r.length) for r in todo]))
        names = Q.sender_names(spark, root, files=json.dumps([(r.path, r.length) for r in todo]))
        rows.write.mode("overwrite").parquet(f"{at}/messages/version={version}")
        names.write.mode("overwrite").parquet(f"{at}/names/version={version}")
        told = spark.read.parquet(f"{at}/messages/version={version}").filter("warning is not null").select("path", "warning").distinct()
        bad = {r.path: r.warning for r in told.collect()}
    if todo and len(bad) == len(files):
        raise OSError(f"no source file could be read: {min(bad.values())}")
    kept = {p: (r.mtime, r.log_mtime, r.status, r.held) for p, r in old.items() if p not in gone}
    for r in todo:
        why = bad.get(r.path)
        before = old[r.path].held if r.path in old else None
        if why is None:
            kept[r.path] = (r.mtime, r.log_mtime, "ok", version)
        elif why.startswith("damaged"):
            kept[r.path] = (r.mtime, r.log_mtime, "damaged", before)
    spark.createDataFrame([(p, *v) for p, v in kept.items()], MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest/version={version}")
    return {"ingested": len(todo) - len(bad), "skipped": len(files) - len(todo), "errors": len(bad)}


def _current(spark: SparkSession, at: str, kind: str) -> DataFrame:
    held = manifest(spark, at).filter("held is not null").select("path", F.col("held").alias("version"))
    return spark.read.parquet(f"{at}/{kind}").filter("warning is null").join(held, ["path", "version"]).drop("path", "version", "warning")


def messages(spark: SparkSession, at: str) -> DataFrame:
    """The stored rows (schema RAW_MESSAGE) of all files, each as of its last good reading."""
    return _current(spark, at, "messages")


def sender_names(spark: SparkSession, at: str) -> DataFrame:
    """(shard, id, user_name) of the same files."""
    return _current(spark, at, "names")


def follow(spark: SparkSession, root: str, at: str, seconds: float | None = None):
    """A streaming query that takes a step every so many seconds, or one step if none are given. A restart takes up the
    clock from its checkpoint and the files from the manifest."""
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return clock.writeStream.foreachBatch(lambda _, __: step(spark, root, at)).option("checkpointLocation", f"{at}/clock").trigger(**trigger).start()
