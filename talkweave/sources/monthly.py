"""Messages written by month, with counts that let a page stop early.

Beside the rows, which are partitioned by month and clustered by (talker, sort_seq), lie their counts by month, talker,
sender and type with the ranges of time and order. From these a page learns a bound of sort_seq beyond which there are
enough rows, so only months that reach it are read: the files of a page do not grow with the store. The counts are as
few as the months that a conversation's members wrote in; the driver gets one row for each month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave import schema as S
from talkweave.operators import messages as M
from talkweave.operators import timeline as TL
from talkweave.operators.privacy import drop_hidden_senders, visible
from talkweave.page import effective_limit


def write(d: DataFrame, at: str) -> None:
    """Messages (at least talker, sender, msg_type and the keys) with their counts; what was there is replaced, counts last."""
    month = F.coalesce(F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM"), F.lit("none"))
    by = ("month", "talker", "sort_seq")
    d.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{at}/schema")  # an empty store has no other file that tells it
    d.withColumn("month", month).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("month").parquet(f"{at}/rows")
    seq, time = F.col("sort_seq"), F.col("create_time")
    each = d.groupBy(month.alias("month"), "talker", "sender", "msg_type").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{name}") for c, name in ((seq, "seq"), (time, "time")) for k, f in (("min", F.min), ("max", F.max))))
    each.write.mode("overwrite").parquet(f"{at}/counts")


def read(spark: SparkSession, at: str) -> DataFrame:
    """All messages with their month."""
    schema = spark.read.parquet(f"{at}/schema").schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.StringType())])).parquet(f"{at}/rows")


def _seen(d: DataFrame, q: M.MessageQuery, hidden: DataFrame | None) -> DataFrame:
    d = M.of_talker(d, q.talker)
    d = d if q.msg_type is None else d.filter(F.col("msg_type") == q.msg_type)
    return d if hidden is None else drop_hidden_senders(visible(d, hidden), hidden)


def reach(counts: DataFrame, q: M.MessageQuery, need: int, hidden: DataFrame | None = None) -> tuple[list[str], int | None]:
    """(months, bound): the months whose rows may be among the first `need` of q in its order, and the last sort_seq that may.

    Counts whose whole range lies in q's are surely rows of q; where those are too few there is no bound. Keywords are not looked at."""
    up = q.ascending or q.after_sort_seq is not None
    s, sure = _seen(counts, q, hidden), F.lit(True)
    if q.after_sort_seq is not None:
        s, sure = s.filter(F.col("max_seq") > q.after_sort_seq), F.col("min_seq") > q.after_sort_seq
    elif q.since != 0 or q.until != S.MAX_LONG:
        s, sure = s.filter((F.col("max_time") >= q.since) & (F.col("min_time") <= q.until)), (F.col("min_time") >= q.since) & (F.col("max_time") <= q.until)
    rows = s.groupBy("month").agg(F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("n"), F.min("min_seq").alias("low"), F.max("max_seq").alias("high")).collect()
    found, bound = 0, None
    for r in sorted(rows, key=lambda r: r.high if up else -r.low):
        found += r.n
        if found >= need:
            bound = r.high if up else r.low
            break
    return sorted(r.month for r in rows if bound is None or (r.low <= bound if up else r.high >= bound)), bound


def page(spark: SparkSession, at: str, q: M.MessageQuery, hidden: DataFrame | None = None) -> DataFrame:
    """messages.page() of the stored rows that are not hidden, reading the months that the page needs.

    With a keyword, which the counts do not know, eight times as many rows are looked at each time until the page is
    full or all is read. Context around a message reads all months of its conversation."""
    q.validate()
    counts, d = spark.read.parquet(f"{at}/counts"), read(spark, at)
    limit = effective_limit(q.limit)
    around = q.around_sort_seq is not None or q.around_server_id is not None
    need = q.offset + limit
    while True:
        months, bound = reach(counts, q, need, hidden) if not around else (None, None)
        part = d if months is None else d.filter(F.col("month").isin(months))
        if bound is not None:
            part = part.filter(F.col("sort_seq") <= bound if q.ascending or q.after_sort_seq is not None else F.col("sort_seq") >= bound)
        # In an anchor's context the type is looked at last, as messages.page() does.
        got = M.page(_seen(part, q.with_(msg_type=None) if around else q, hidden).drop("month"), q)
        if bound is None or q.keyword is None or got.count() == limit:
            return got
        need *= 8


def timeline(spark: SparkSession, at: str, sessions: DataFrame, since: int, until: int, msg_type: int | None = None, hidden: DataFrame | None = None, need: int = S.MAX_LIMIT, ascending: bool = False) -> tuple[DataFrame, int]:
    """(rows, total): timeline.timeline() of the months that hold its first `need` rows in order of time, and how many rows all have.

    Months follow each other in time, so the counts tell which are needed. The total is theirs too, but for months that
    the range cuts (at most two where each month has all of its times), whose rows are counted."""
    if since > until:
        raise ValueError("since must not be after until")
    s = spark.read.parquet(f"{at}/counts").filter((F.col("max_time") >= since) & (F.col("min_time") <= until))
    s = TL.known(s if msg_type is None else s.filter(F.col("msg_type") == msg_type), sessions, hidden)
    sure = (F.col("min_time") >= since) & (F.col("max_time") <= until)
    by = s.groupBy("month").agg(F.sum("n").alias("n"), F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("sure"), F.min("min_time").alias("t"))
    rows = sorted(by.collect(), key=lambda r: r.t if ascending else -r.t)  # one a month
    found, months = 0, []
    for r in rows:
        if found >= need:
            break
        months.append(r.month)
        found += r.sure
    all_rows = lambda own: TL.timeline(read(spark, at).filter(F.col("month").isin(own)), sessions, since, until, msg_type, hidden).drop("month")
    cut = [r.month for r in rows if r.sure < r.n]
    total = sum(r.n for r in rows if r.sure == r.n) + (all_rows(cut).count() if cut else 0)
    return all_rows(months), total
