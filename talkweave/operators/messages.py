"""Message history: filters, stable pages, context around an anchor, cursors and watermarks.

Messages are ordered by (sort_seq, create_time, server_id). Pages are TakeOrderedAndProject, so no
partition keeps more than offset + limit rows; filters on talker, create_time and msg_type reach the
Parquet scan of a written store (an adapter's talker and time are expressions, and are filtered after it)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave import schema as S
from talkweave.functions.content import matches, searchable
from talkweave.operators.running import running
from talkweave.page import effective_limit

KEY = ("sort_seq", "create_time", "server_id")


def ordered(ascending: bool, keys: tuple[str, ...] = KEY) -> list[Column]:
    return [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]


@dataclass(frozen=True)
class MessageQuery:
    """What to read of one conversation. Builders return changed copies."""

    talker: str | None = None
    since: int = 0
    until: int = S.MAX_LONG
    msg_type: int | None = None
    keyword: str | None = None
    limit: int = 0
    offset: int = 0
    ascending: bool = False
    around_sort_seq: int | None = None
    around_server_id: int | None = None
    after_sort_seq: int | None = None
    context: int = S.DEFAULT_CONTEXT

    def with_(self, **changes) -> MessageQuery:
        return replace(self, **changes)

    def validate(self) -> MessageQuery:
        """Anchors exclude each other, a time range and an offset."""
        anchors = [a for a in (self.around_sort_seq, self.around_server_id, self.after_sort_seq) if a is not None]
        if len(anchors) > 1:
            raise ValueError("at most one of around_sort_seq, around_server_id and after_sort_seq")
        if anchors and (self.since != 0 or self.until != S.MAX_LONG):
            raise ValueError("an anchor excludes since and until")
        if anchors and self.offset:
            raise ValueError("an anchor needs offset 0")
        if self.limit < 0 or self.offset < 0 or self.context < 0:
            raise ValueError("limit, offset and context must not be negative")
        return self


def of_talker(messages: DataFrame, talker: str | None) -> DataFrame:
    return messages if talker is None else messages.filter(F.col("talker") == talker)


def filtered(messages: DataFrame, q: MessageQuery) -> DataFrame:
    """Rows of the talker in the inclusive time range, of the type, with the keyword."""
    d = of_talker(messages, q.talker)
    if q.since != 0 or q.until != S.MAX_LONG:
        d = d.filter(F.col("create_time").between(q.since, q.until))
    return _narrowed(d, q)


def _narrowed(d: DataFrame, q: MessageQuery) -> DataFrame:
    if q.msg_type is not None:
        d = d.filter(F.col("msg_type") == q.msg_type)
    if q.keyword is not None:
        d = d.filter(matches(searchable(F.col("content_kind"), F.col("content")), q.keyword))
    return d


def page(messages: DataFrame, q: MessageQuery) -> DataFrame:
    """The rows that q asks for, in order."""
    q.validate()
    if q.around_sort_seq is not None:
        return around_sort_seq(messages, q)
    if q.around_server_id is not None:
        return around_server_id(messages, q)
    if q.after_sort_seq is not None:
        return after_sort_seq(messages, q)
    return filtered(messages, q).orderBy(*ordered(q.ascending)).offset(q.offset).limit(effective_limit(q.limit))


def after_sort_seq(messages: DataFrame, q: MessageQuery) -> DataFrame:
    """Rows strictly after the cursor, ascending; filters come before the limit."""
    d = of_talker(messages, q.talker).filter(F.col("sort_seq") > q.after_sort_seq)
    return _narrowed(d, q).orderBy(*ordered(True)).limit(effective_limit(q.limit))


def around_sort_seq(messages: DataFrame, q: MessageQuery) -> DataFrame:
    """The nearest `context` rows before the pivot, all rows at it and the nearest after, ascending; filters come last."""
    d, seq = of_talker(messages, q.talker), F.col("sort_seq")
    before = d.filter(seq < q.around_sort_seq).orderBy(*ordered(False)).limit(q.context)
    after = d.filter(seq > q.around_sort_seq).orderBy(*ordered(True)).limit(q.context)
    return _narrowed(before.unionByName(d.filter(seq == q.around_sort_seq)).unionByName(after), q).orderBy(*ordered(True))


def around_server_id(messages: DataFrame, q: MessageQuery) -> DataFrame:
    """The same around the message of an id, in the order of all three keys; empty if there is none.

    If several rows share the id, the first of them is the pivot, and all are returned."""
    d = of_talker(messages, q.talker)
    own = d.filter(F.col("server_id") == q.around_server_id)
    pivot = own.agg(F.min(F.struct(*KEY)).alias("__pivot"))  # one row
    at = d.withColumn("__key", F.struct(*KEY)).join(pivot.hint("broadcast"), F.col("__pivot").isNotNull())
    before = at.filter("__key < __pivot").orderBy(*ordered(False)).limit(q.context)
    after = at.filter("__key > __pivot").orderBy(*ordered(True)).limit(q.context)
    parts = before.drop("__key", "__pivot").unionByName(own).unionByName(after.drop("__key", "__pivot")).distinct()
    return _narrowed(parts, q).orderBy(*ordered(True))


def around_many(messages: DataFrame, pivots: DataFrame, context: int) -> DataFrame:
    """Context of many pivots (talker, pivot_seq) at once: each pivot's rows with its pivot_seq.

    Rows and pivots of a talker stand in one order, in which the running count of rows is the rank of a row and, at a
    pivot, the number of rows before it. Rows at a pivot meet it by their key; those around it by at most `context`
    ranks on either side. No talker is one task (see running)."""
    kind, seq = F.lit(1).alias("__kind"), F.col("pivot_seq").alias("sort_seq")
    marks = pivots.select("talker", seq, F.lit(0).alias("__kind")).distinct()
    both = messages.select("*", kind).unionByName(marks, allowMissingColumns=True)
    order = [F.col(c).asc() for c in ("sort_seq", "__kind", *KEY[1:])]  # a pivot comes before the rows at it
    placed = running(both, ["talker"], order, counts={"__rank": F.col("__kind") == 1})
    rows = placed.filter("__kind = 1").drop("__kind")
    at = marks.select("talker", "sort_seq", F.lit(1).alias("__one"))
    same = rows.join(at, ["talker", "sort_seq"]).drop("__one")
    held = same.groupBy("talker", "sort_seq").agg(F.count("*").alias("__n"))
    reach = placed.filter("__kind = 0").select("talker", "sort_seq", F.col("__rank").alias("__before")).join(held, ["talker", "sort_seq"], "left")
    below = F.col("__before") + F.coalesce("__n", F.lit(0))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(max(context, 1))), lambda k: F.array(F.col("__before") - k + 1, below + k))
    each = reach.select("talker", F.col("sort_seq").alias("pivot_seq"), F.explode(F.flatten(ranks)).alias("__rank")).filter(F.lit(context > 0) & (F.col("__rank") > 0))
    out = same.withColumn("pivot_seq", F.col("sort_seq")).unionByName(rows.join(each, ["talker", "__rank"]))
    return out.drop("__rank")


def count_messages(messages: DataFrame, q: MessageQuery, with_keyword: bool = False) -> DataFrame:
    """One row: total, of a talker under the time range and type, and under the keyword if it is to count."""
    return filtered(messages, q if with_keyword else q.with_(keyword=None)).agg(F.count("*").alias("total"))


def max_seq(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(talker, max_seq) of every known conversation, 0 for those without messages."""
    top = messages.groupBy("talker").agg(F.max("sort_seq").alias("max_seq"))
    return sessions.select(F.col("username").alias("talker")).join(top, "talker", "left").select("talker", F.coalesce("max_seq", F.lit(0).cast("long")).alias("max_seq"))


def watermark(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: the largest max_seq, 0 if there is none."""
    return max_seq(messages, sessions).agg(F.coalesce(F.max("max_seq"), F.lit(0).cast("long")).alias("watermark"))


def shard_ranges(shards: DataFrame) -> DataFrame:
    """Adds end_time: a shard ends before the next one starts, the last never. Unreadable starts are 0."""
    w = Window.orderBy("start_time", "shard_id")  # one row for each file
    s = shards.withColumn("start_time", F.coalesce("start_time", F.lit(0).cast("long")))
    return s.withColumn("end_time", F.coalesce(F.lead("start_time").over(w) - 1, F.lit(S.MAX_LONG)))


def shards_for_range(ranges: DataFrame, since: int, until: int) -> DataFrame:
    """Shards whose range meets [since, until]; only ever used to read less, never to hide rows."""
    return ranges.filter((F.col("start_time") <= until) & (F.col("end_time") >= since))
