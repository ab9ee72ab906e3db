"""Queries of change streams: a whole replay through Structured Streaming, and the same as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.plans.catalog import query
from talkweave.plans.views import EVT
from talkweave.session import shared
from talkweave.sources import adapters as A
from talkweave.sources.settings import Settings
from talkweave.store import ChatStore
from talkweave.streaming import changes as C
from talkweave.streaming import delivery

SNAP = f"""{EVT}, snap AS (
  SELECT create_time // 1209600 AS snapshot, talker AS username, max(create_time) - CASE WHEN (create_time // 1209600) % 3 = 0 THEN 2000000 ELSE 0 END AS sort_timestamp
  FROM evt GROUP BY create_time // 1209600, talker
)"""
DIFF = f"""WITH {SNAP} SELECT snapshot, username, sort_timestamp FROM (SELECT *, lag(sort_timestamp) OVER (PARTITION BY username ORDER BY snapshot) AS b FROM snap) WHERE b IS NULL OR sort_timestamp > b"""


def snapshots(events: DataFrame) -> DataFrame:
    """One row for each conversation and fortnight; every third listing is of older times."""
    d = events.select(F.expr("create_time div 1209600").alias("snapshot"), F.col("talker").alias("username"), "create_time")
    return d.groupBy("snapshot", "username").agg((F.max("create_time") - F.when(F.col("snapshot") % 3 == 0, 2000000).otherwise(0)).alias("sort_timestamp"))


def replay(spark: SparkSession, batches: DataFrame | list[DataFrame], change) -> DataFrame:
    """The rows that change(stream) emits for the batches, each written to the stream's source and run to its end; state is taken up from the checkpoint."""
    at, batches = shared(spark), batches if isinstance(batches, list) else [batches]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)
    try:
        for d in batches:
            d.write.mode("append").parquet(f"{at}/in")
            out = change(spark.readStream.schema(d.schema).parquet(f"{at}/in"))
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(DIFF)
def session_diff_replay(spark: SparkSession, root: str) -> DataFrame:
    return C.replay_sessions(snapshots(A.events(spark, root)))


@query(DIFF)
def session_diff_stream(spark: SparkSession, root: str) -> DataFrame:
    return replay(spark, listings(snapshots(A.events(spark, root))), C.session_events)


def listings(d: DataFrame) -> list[DataFrame]:
    """One micro-batch for each listing; there are as many as fortnights."""
    return [d.filter(F.col("snapshot") == r.snapshot) for r in d.select("snapshot").distinct().orderBy("snapshot").collect()]


@query(f"WITH {SNAP} SELECT snapshot, username, sort_timestamp FROM (SELECT *, lag(sort_timestamp) OVER (PARTITION BY username ORDER BY snapshot) AS b FROM snap) WHERE (b IS NULL OR sort_timestamp > b) AND snapshot > (SELECT min(snapshot) FROM snap)")
def session_baseline_stream(spark: SparkSession, root: str) -> DataFrame:
    known, *later = listings(snapshots(A.events(spark, root)))
    return replay(spark, later, lambda s: C.session_events(s, known.select("username", "sort_timestamp")))


BATCH = "CASE WHEN create_time < 1705000000 AND server_id % 5 <> 0 THEN 1 WHEN create_time >= 1705000000 AND talker NOT LIKE '%@chatroom' THEN 2 ELSE 3 END"


@query(f"""WITH {EVT}, b AS (SELECT *, {BATCH} AS k FROM evt), top AS (SELECT talker, k, max(sort_seq) AS s FROM b GROUP BY ALL),
c AS (SELECT talker, k, max(s) OVER (PARTITION BY talker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM top)
SELECT b.talker, sort_seq, create_time, server_id FROM b JOIN c ON c.talker = b.talker AND c.k = b.k WHERE sort_seq > coalesce(s, 0)""")
def late_message_stream(spark: SparkSession, root: str) -> DataFrame:
    """Three micro-batches; what the last one has at or before its conversation's cursor never comes."""
    d = A.events(spark, root).select("talker", "sort_seq", "create_time", "server_id")
    return replay(spark, [d.filter(F.expr(BATCH) == k) for k in (1, 2, 3)], C.new_messages)


@query(f"WITH {EVT}, c AS (SELECT talker, max(sort_seq) AS s FROM evt WHERE create_time < 1705000000 AND talker NOT LIKE '%@chatroom' GROUP BY talker) SELECT evt.talker, sort_seq, create_time, server_id FROM evt LEFT JOIN c USING (talker) WHERE sort_seq > coalesce(s, 1704600000000)")
def new_message_stream(spark: SparkSession, root: str) -> DataFrame:
    d = A.events(spark, root).select("talker", "sort_seq", "create_time", "server_id")
    cursors = d.filter("create_time < 1705000000 AND talker NOT LIKE '%@chatroom'").groupBy("talker").agg(F.max("sort_seq").alias("max_seq"))
    return replay(spark, d, lambda s: C.new_messages(s, 1704600000000, cursors))


HALF = "CASE WHEN create_time < 1705000000 AND server_id % 5 <> 0 THEN 1 ELSE 2 END"


@query(f"""WITH {EVT}, b AS (SELECT *, {HALF} AS k FROM evt), ses AS (SELECT k, talker, max(create_time) AS t FROM b GROUP BY ALL), top AS (SELECT talker, max(sort_seq) AS s FROM b WHERE k = 1 GROUP BY talker),
moved AS (SELECT k, 'session' AS type, talker, k AS seq, NULL::BIGINT AS id FROM (SELECT *, lag(t) OVER (PARTITION BY talker ORDER BY k) AS before FROM ses) WHERE before IS NULL OR t > before),
fresh AS (SELECT k, 'message' AS type, b.talker, sort_seq AS seq, server_id AS id FROM b LEFT JOIN top ON top.talker = b.talker WHERE (k = 1 OR sort_seq > coalesce(s, 0)) AND NOT (b.talker LIKE '%@chatroom' AND sender IN ('c12', 'c33', 'c60')))
SELECT type, talker, seq, id, row_number() OVER (ORDER BY k, talker, type = 'session' DESC, seq, id) AS position FROM (SELECT * FROM moved UNION ALL SELECT * FROM fresh) WHERE talker NOT IN ('u7', 'u6@chatroom')""")
def delivered_events(spark: SparkSession, root: str) -> DataFrame:
    """Session and message events of two micro-batches in one query with a ledger. The second batch is lost twice before its commit
    is told to the checkpoint, first without and then with its ledger row; it is run again and writes nothing twice. Hidden talkers
    and hidden senders of groups are left out after the cursors have moved over them."""
    at, d = shared(spark), A.events(spark, root).withColumn("k", F.expr(HALF).cast("long"))
    none = spark.createDataFrame([], "user_name string, remark string, nick_name string, alias string, labels array<string>")
    store = ChatStore(d.limit(0), spark.createDataFrame([], "username string"), none, settings=Settings(ignore_contacts=["u7", "u6@chatroom", "c12", "c33", "c60"]))
    listed = d.groupBy(F.col("k").alias("snapshot"), F.col("talker").alias("username")).agg(F.max("create_time").alias("sort_timestamp"))
    rows = d.select("talker", "sender", "sort_seq", "create_time", "server_id", "k")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)

    def run(lost: tuple[str, ...] = ()) -> None:
        for path in lost:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/to/{path}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        stream = lambda x, name: spark.readStream.schema(x.schema).parquet(f"{at}/{name}")
        delivery.deliver(store.events(stream(listed, "sessions"), stream(rows, "messages")), f"{at}/to").awaitTermination()

    try:
        for k in (1, 2):
            listed.filter(F.col("snapshot") == k).write.mode("append").parquet(f"{at}/sessions")
            rows.filter(F.col("k") == k).write.mode("append").parquet(f"{at}/messages")
            run()
        run(("checkpoint/commits/1", "checkpoint/commits/.1.crc", "ledger/row=1"))
        run(("checkpoint/commits/1", "checkpoint/commits/.1.crc"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return delivery.read(spark, f"{at}/to", buffer=None).select("type", "talker", "seq", "id", "position")
