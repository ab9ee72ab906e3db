"""Delivery of events to readers that come and go: each micro-batch once, sessions and messages in one commit.

Below a folder there are the events of each micro-batch, a ledger with one row for each that is whole, and the checkpoint,
so batch numbers and ledger live and die together. A batch is delivered when its ledger row is there: one that was lost on
the way is written again in place, one that is in the ledger is not written again, and readers never see half of one.
The epoch is the number of delivered batches, so a failed one does not count.

Each event has a position from 1 in the order of batches, and in a batch by conversation: first what the session did, then
its messages. A reader asks for what follows a position. One that lags by more than the buffer gets the buffer alone and
can tell it from the first position that it gets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators.running import running

BUFFER = 512
EVENT = "type string, talker string, seq long, id long, payload string"
LEDGER = "batch long, n long, total long"
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def ledger(spark: SparkSession, at: str) -> DataFrame:
    """(batch, n, total): the delivered batches, how many events each has, and how many there are up to it."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{at}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def last(spark: SparkSession, at: str) -> tuple[int, int]:
    """(number of the last delivered batch or -1, how many events there are)."""
    r = ledger(spark, at).agg(F.max(F.struct("batch", "total")).alias("m")).first().m
    return (r.batch, r.total) if r else (-1, 0)


def commit(events: DataFrame, batch: int, at: str) -> bool:
    """Writes a micro-batch of events (EVENT) and then its ledger row; false if it had been delivered. Batches come in order."""
    spark = events.sparkSession
    done, total = last(spark, at)
    if batch <= done:
        return False
    order = [F.col("talker").asc(), (F.col("type") == "session").desc(), F.col("seq").asc(), F.col("id").asc(), F.col("payload").asc()]
    ranked = running(events.select(*NAMES), [], order, rank="position", at=f"{at}/ranges/{batch}")
    to = f"{at}/events/batch={batch}"
    ranked.withColumn("position", F.col("position") + total).write.mode("overwrite").parquet(to)
    n = spark.read.schema("position long").parquet(to).count()
    row = spark.createDataFrame([(batch, n, total + n)], LEDGER).coalesce(1)
    row.write.mode("overwrite").parquet(f"{at}/ledger/row={batch}")
    return True


def deliver(events: DataFrame, at: str, seconds: float | None = None):
    """A streaming query that delivers a stream of events every so many seconds, or what there is if none are given."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return events.writeStream.foreachBatch(lambda d, batch: commit(d, batch, at)).option("checkpointLocation", f"{at}/checkpoint").trigger(**trigger).start()


def epoch(spark: SparkSession, at: str) -> int:
    return ledger(spark, at).count()


def read(spark: SparkSession, at: str, after: int = 0, buffer: int | None = BUFFER) -> DataFrame:
    """Delivered events after a position, at most the latest `buffer` (None: all), in no order; only the batches that hold some are read."""
    done, total = last(spark, at)
    if done < 0:
        return spark.createDataFrame([], f"{EVENT}, position long, batch long")
    low = max(after, total - buffer) if buffer is not None else after
    first = ledger(spark, at).filter(F.col("total") > low).agg(F.min("batch")).first()[0]
    d = spark.read.schema(f"{EVENT}, position long, batch long").parquet(f"{at}/events")
    return d.filter(F.col("batch").between(done + 1 if first is None else first, done) & (F.col("position") > low))
