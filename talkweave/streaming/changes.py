"""Change streams: which sessions moved, and which messages are new, with state by conversation.

State is one long for each key in the state store. Rows of a micro-batch come in any order: listings of
a session are sorted first; messages only need the cursor from before the batch, and their order is in their keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STATE = StructType([StructField("value", LongType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionDiff(StatefulProcessor):
    """Emits a session when it is new or its time is later than in the snapshot before, which every row then replaces, even by an earlier time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = pd.concat(list(rows)).sort_values("snapshot", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in d["sort_timestamp"]:
            keep.append(last is None or t > last)
            last = int(t)
        self.last.update((last,))
        yield d[keep]

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.last.update((int(initialState["sort_timestamp"].max()),))

    def close(self) -> None:
        pass


class NewMessages(StatefulProcessor):
    """Emits messages after the conversation's cursor, which moves to the last one of the batch; those at or before it never come."""

    def __init__(self, baseline: int = 0):
        self.baseline = baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = cursor = self.cursor.get()[0] if self.cursor.exists() else self.baseline
        for d in rows:  # a busy conversation comes in parts, and is never held whole
            new = d[d["sort_seq"] > cursor]
            if len(new):
                last = max(last, int(new["sort_seq"].max()))
                yield new
        if last > cursor:
            self.cursor.update((last,))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.cursor.update((int(initialState["max_seq"].max()),))

    def close(self) -> None:
        pass


def session_events(sessions: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Sessions (with `snapshot`, the number of the listing they are from) that moved. baseline: what is known already and is not told again."""
    known = baseline.groupBy("username") if baseline is not None else None
    return sessions.groupBy("username").transformWithStateInPandas(SessionDiff(), sessions.schema, "append", "none", initialState=known)


def new_messages(messages: DataFrame, baseline: int = 0, cursors: DataFrame | None = None) -> DataFrame:
    """Messages after their conversation's cursor. cursors: (talker, max_seq) at the start; baseline: for talkers unknown then."""
    known = cursors.groupBy("talker") if cursors is not None else None
    return messages.groupBy("talker").transformWithStateInPandas(NewMessages(baseline), messages.schema, "append", "none", initialState=known)


def tagged(events: DataFrame, kind: str, talker: str | None = None, seq: str | None = None, number: str | None = None) -> DataFrame:
    """(type, talker, seq, id, payload): rows of a stream as JSON under the name of their kind, and their keys as columns; keys that are not named are null."""
    keys = [(F.col(c) if c else F.lit(None)).cast(t).alias(n) for c, t, n in ((talker, "string", "talker"), (seq, "long", "seq"), (number, "long", "id"))]
    return events.select(F.lit(kind).alias("type"), *keys, F.to_json(F.struct(*events.columns)).alias("payload"))


def replay_sessions(snapshots: DataFrame) -> DataFrame:
    """What session_events() emits for all snapshots, as a batch: rows later than the one before of the same name."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("username").orderBy("snapshot")
    before = F.lag("sort_timestamp").over(w)
    return snapshots.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("sort_timestamp") > F.col("__b"))).drop("__b")


def write_json(stream: DataFrame, path: str, checkpoint: str):
    """JSON lines of a stream, in micro-batches that are whole or absent."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeats(spark: SparkSession, seconds: int = 15) -> DataFrame:
    """A stream of (type, payload) rows, one every so many seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)
    return ticks.select(F.lit("heartbeat").alias("type"), F.to_json(F.struct(F.unix_seconds("timestamp").alias("at"))).alias("payload"))
