"""Star-schema tables read as chat tables. Each adapter is a plain projection, so filters and column
pruning still reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions import labels

EPOCH = 1_700_000_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def text_content(text: Column) -> Column:
    return F.struct(*((text if f.name == "text" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CONTENT.fields))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def conversations(spark: SparkSession, root: str) -> DataFrame:
    """Messages of the conversations table, one conversation in three a group."""
    d, c = table(spark, root, "conversations"), F.col("conv_id")
    return d.select(
        F.col("turn").alias("sort_seq"),
        (c * 1000 + F.col("turn")).alias("server_id"),
        F.lit(1).cast("long").alias("msg_type"),
        F.lit(0).cast("long").alias("sub_type"),
        F.col("role").alias("sender"),
        F.concat(F.lit("conv_"), c.cast("string"), F.when(c % 3 == 0, S.GROUP_SUFFIX).otherwise("")).alias("talker"),
        (c * 3600 + F.col("turn") * 60 + EPOCH).alias("create_time"),
        F.lit(0).alias("status"),
        F.lit("Text").alias("content_kind"),
        text_content(F.col("text")).alias("content"),
    )


# Message codes that stand for event types.
EVENT_CODES = {"view": 1, "click": 3, "purchase": 49, "signup": 10000, "error": 10002}


def events(spark: SparkSession, root: str) -> DataFrame:
    """Messages of the events table: fifty conversations, one in three a group."""
    d, u, t = table(spark, root, "events"), F.col("user_id"), micros(F.col("ts"))
    code = F.lit(47)
    for name, k in EVENT_CODES.items():
        code = F.when(F.col("event_type") == name, k).otherwise(code)
    return d.select(
        t.alias("__t"), "event_id", code.cast("long").alias("msg_type"), F.lit(0).cast("long").alias("sub_type"), F.concat(F.lit("c"), u.cast("string")).alias("sender"),
        F.concat(F.lit("u"), (u % 50).cast("string"), F.when(u % 3 == 0, S.GROUP_SUFFIX).otherwise("")).alias("talker"), "props",
    ).select(
        F.expr("__t div 1000").alias("sort_seq"), F.col("event_id").alias("server_id"), "msg_type", "sub_type", "sender", "talker", F.expr("__t div 1000000").alias("create_time"),
        F.lit(0).alias("status"), F.lit("Text").alias("content_kind"), text_content(F.col("props")).alias("content"),
    )


# Composite codes that stand for line numbers.
LINE_CODES = {1: 1, 2: 3, 3: 34, 4: (5 << 32) | 49, 5: (57 << 32) | 49, 6: (6 << 32) | 49, 7: 10000}


def lines(spark: SparkSession, root: str) -> DataFrame:
    """Messages of the lineitem table, the large one: many equal sort keys, ids that repeat, composite codes."""
    d = table(spark, root, "lineitem")
    code = F.lit(1).cast("long")
    for n, k in LINE_CODES.items():
        code = F.when(F.col("l_linenumber") == n, F.lit(k)).otherwise(code)
    seconds = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000000")
    return d.select(
        (seconds * 1000).alias("sort_seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("server_id"), code.alias("local_type"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 1500).cast("string")).alias("sender"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("talker"), seconds.alias("create_time"),
        "l_linestatus", "l_returnflag", "l_quantity", "l_partkey",
    ).withColumns({"msg_type": labels.msg_type(F.col("local_type")), "sub_type": labels.sub_type(F.col("local_type"))})


def contacts(spark: SparkSession, root: str) -> DataFrame:
    """Contacts of customers and their nations."""
    c, n = table(spark, root, "customer"), table(spark, root, "nation")
    k = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(
        F.concat(F.lit("c"), k.cast("string")).alias("user_name"),
        F.when(k % 2 == 0, F.concat(F.lit("al"), k.cast("string"))).otherwise("").alias("alias"),
        F.when(k % 5 == 0, F.concat(F.lit("Remark "), k.cast("string"))).otherwise("").alias("remark"),
        F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("nick_name"),
        F.when(k % 11 == 0, "memo of a friend").alias("memo"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("signature"),
        F.col("n_name").alias("region"),
        F.when(k % 3 == 0, F.concat(F.lit("http://a/"), k.cast("string"))).alias("avatar_url"),
        (k % 3).cast("long").alias("gender"),
        (k % 8).cast("long").alias("source_scene"),
        F.array("c_mktsegment").alias("labels"),
    )


def sessions_of(messages: DataFrame) -> DataFrame:
    """Sessions by the last message of each conversation."""
    last = F.max(F.struct("create_time", "sort_seq", "server_id", "sender", "msg_type", F.col("content.text").alias("text")))
    return messages.groupBy("talker").agg(last.alias("m")).select(
        F.col("talker").alias("username"), F.col("m.create_time").alias("sort_timestamp"), F.col("m.text").alias("summary"),
        F.col("m.msg_type").alias("last_msg_type"), F.col("m.sender").alias("last_msg_sender"), F.lit(None).cast("string").alias("last_sender_display_name"),
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Messages of the documents table, the corpus that is searched."""
    d = table(spark, root, "documents")
    return d.select(
        F.col("doc_id").alias("sort_seq"), F.col("doc_id").alias("server_id"), F.lit(1).cast("long").alias("msg_type"), F.lit(0).cast("long").alias("sub_type"),
        F.col("lang").alias("sender"), F.col("source").alias("talker"), (F.col("doc_id") % 1000 + EPOCH).alias("create_time"),
        F.lit(0).alias("status"), F.lit("Text").alias("content_kind"), text_content(F.col("text")).alias("content"),
    )
