"""Queries over SQLite files, which Spark tasks write from the driver's tables first: pushed filters, logs, and ingest again and again."""

from __future__ import annotations

import os
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import text
from talkweave.operators import media
from talkweave.plans.catalog import query
from talkweave.plans.views import EVT
from talkweave.session import shared
from talkweave.sources import adapters as A
from talkweave.sources import ingest
from talkweave.sources import sqlite_source as Q

CHECKPOINTED, COMMITTED, UNFINISHED = 0, 1, 2
COLUMNS = ("sort_seq", "server_id", "local_type", "real_sender_id", "create_time", "message_content")


def write_shards(rows: DataFrame, root: str) -> None:
    """Message shards of rows (shard, table_name, the COLUMNS, state), one task a file: rows are in the file, committed in its
    log, or in the log's unfinished tail."""

    def put(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = f"{root}/message/message_{key[0].as_py()}.db"
        with tempfile.TemporaryDirectory() as folder:
            db = sqlite3.connect(f"{folder}/x.db", isolation_level=None)
            for s in ("PRAGMA journal_mode=WAL", "PRAGMA wal_autocheckpoint=0", "CREATE TABLE Name2Id (user_name TEXT)", "BEGIN"):
                db.execute(s)
            for state in (CHECKPOINTED, COMMITTED, UNFINISHED):
                if state:
                    db.execute("BEGIN")
                if state == UNFINISHED:
                    db.execute("PRAGMA cache_size=1")  # so that pages go to the log before their commit
                part = table.filter(pa.compute.equal(table.column("state"), state))
                for name in sorted(set(table.column("table_name").to_pylist())):
                    if not state:
                        db.execute(f'CREATE TABLE "{name}" (sort_seq INTEGER, server_id INTEGER, local_type INTEGER, real_sender_id INTEGER, create_time INTEGER, message_content TEXT)')
                        db.execute(f'CREATE INDEX "t{name}" ON "{name}" (create_time)')
                    own = part.filter(pa.compute.equal(part.column("table_name"), name))
                    db.executemany(f'INSERT INTO "{name}" VALUES (?, ?, ?, ?, ?, ?)', zip(*(own.column(c).to_pylist() for c in COLUMNS), strict=True))
                if state != UNFINISHED:
                    db.execute("COMMIT")
                if not state:
                    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
            for end in ("", Q.LOG) if os.path.getsize(f"{folder}/x.db{Q.LOG}") else ("",):
                save(f"{folder}/x.db{end}", at + end)
            db.close()
        return pa.table({"path": [at]})

    rows.groupBy("shard").applyInArrow(put, "path string").count()


def save(source: str, to: str) -> None:
    """Copies a file of this machine into the shared folder."""
    from pyarrow import fs

    system, at = Q.place(to)
    system = system or fs.LocalFileSystem()
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with open(source, "rb") as f, system.open_output_stream(at) as out:
        while piece := f.read(1 << 20):
            out.write(piece)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The events as rows of shards; files grow in number with the rows, and shard % 4 is the id's."""
    d = A.events(spark, root)
    each = max(1, d.count() // 200_000)
    shard = F.col("server_id") % 4 + 4 * F.pmod(F.xxhash64("server_id"), F.lit(each))
    return d.select(shard.cast("int").alias("shard"), text.table_name(F.col("talker")).alias("table_name"), "sort_seq", "server_id", F.col("msg_type").alias("local_type"), F.lit(1).cast("long").alias("real_sender_id"), "create_time", F.col("content.text").alias("message_content"), F.lit(CHECKPOINTED).alias("state"))


def _told(d: DataFrame) -> DataFrame:
    return d.select("table_name", "server_id", "sort_seq", "create_time", F.col("message_content").cast("string").alias("body"))


BODY = "'Msg_' || md5(talker) AS table_name, server_id, sort_seq, create_time, text AS body"


@query(f"WITH {EVT} SELECT {BODY} FROM evt WHERE talker = 'u7' AND create_time BETWEEN 1704000000 AND 1705600000 AND msg_type = 3")
def sqlite_conversation(spark: SparkSession, root: str) -> DataFrame:
    """One conversation of all files, by filters that the files evaluate."""
    at = shared(spark)
    write_shards(stored(spark, root), at)
    return _told(Q.conversation(spark, at, "u7", 1704000000, 1705600000, 3))


@query(f"WITH {EVT} SELECT {BODY} FROM evt WHERE server_id % 7 <> 3")
def log_messages(spark: SparkSession, root: str) -> DataFrame:
    """All files with their logs: committed rows of a log are there, those of an unfinished transaction are not."""
    at, k = shared(spark), F.col("server_id") % 7
    write_shards(stored(spark, root).withColumn("state", F.when(k == 2, COMMITTED).when(k == 3, UNFINISHED).otherwise(CHECKPOINTED)), at)
    return _told(Q.raw_messages(spark, at).filter("warning is null"))


@query(f"WITH {EVT} SELECT {BODY} FROM evt WHERE server_id % 4 <> 3 OR server_id % 3 <> 0")
def ingest_replay(spark: SparkSession, root: str) -> DataFrame:
    """A stream over the folder, stopped and started again. At first the files lack a third of the rows and those of one in
    four have old texts; then two in four are written anew and one in four is damaged, whose first rows stay."""
    at, d = shared(spark), stored(spark, root)
    kept, role = f"{at}/kept", F.col("shard") % 4
    first = d.filter((role == 0) | (F.col("server_id") % 3 != 0))
    write_shards(first.withColumn("message_content", F.when(role == 1, "old").otherwise(F.col("message_content"))), at)
    ingest.follow(spark, at + "/message", kept).awaitTermination()
    write_shards(d.filter(role.isin(1, 2)).withColumn("state", F.when(F.col("server_id") % 3 == 0, COMMITTED).otherwise(CHECKPOINTED)), at)
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/bad", "wb") as f:
            f.write(b"no database")
        for r in d.filter(role == 3).select("shard").distinct().collect():  # one a file
            save(f"{folder}/bad", f"{at}/message/message_{r.shard}.db")
    for _ in range(2):  # the second time there is nothing to do
        ingest.follow(spark, at + "/message", kept).awaitTermination()
    return _told(ingest.messages(spark, kept))


def write_resources(rows: DataFrame, root: str) -> None:
    """Resource files of rows (file, local_id, packed_info), one task a file."""

    def put(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = f"{root}/message/message_resource_{key[0].as_py()}.db"
        with tempfile.TemporaryDirectory() as folder:
            db = sqlite3.connect(f"{folder}/x.db")
            db.execute("CREATE TABLE MessageResourceInfo (local_id INTEGER PRIMARY KEY, packed_info BLOB)")
            db.executemany("INSERT INTO MessageResourceInfo VALUES (?, ?)", zip(table.column("local_id").to_pylist(), table.column("packed_info").to_pylist(), strict=True))
            db.commit()
            db.close()
            save(f"{folder}/x.db", at)
        return pa.table({"path": [at]})

    rows.groupBy("file").applyInArrow(put, "path string").count()


def resource_rows(spark: SparkSession, root: str) -> DataFrame:
    """A resource for four parts in five, with a digest behind the marker, one alone, one in upper case, or none."""
    d, k = A.table(spark, root, "part"), F.col("p_partkey")
    each = max(1, d.count() // 100_000)
    digest, head = F.md5(F.col("p_name").cast("binary")), F.unhex(F.lit("080112220A20"))
    blob = F.when(k % 4 == 0, F.concat(head, digest.cast("binary"))).when(k % 4 == 1, digest.cast("binary")).when(k % 4 == 2, F.concat(head, F.upper(F.concat(F.lit("f"), F.substr(digest, F.lit(2)))).cast("binary"))).otherwise(F.lit(b"none"))
    return d.filter(k % 5 != 0).select(F.pmod(F.xxhash64(k), F.lit(4 * each)).cast("int").alias("file"), k.cast("long").alias("local_id"), blob.alias("packed_info"))


DIGEST = "CASE WHEN l_partkey % 5 <> 0 AND l_partkey % 4 < 2 THEN md5(p_name) END"


@query(f"SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS server_id, {DIGEST} AS digest FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def resource_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Digests of all messages by the local ids of their resources, which are read from files."""
    at = shared(spark)
    write_resources(resource_rows(spark, root), at)
    d = A.lines(spark, root).select("server_id", F.col("l_partkey").cast("long").alias("local_id"))
    return media.with_resource(d, Q.resources(spark, at)).select("server_id", F.col("resource_md5").alias("digest"))
