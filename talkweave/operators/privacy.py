"""What a settings file hides: talkers, senders in groups, and quotes of hidden senders.

Hidden ids are a small table of one column; all tests are left joins or anti joins on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions import text, xmltext
from talkweave.functions.content import snippet


def hidden_ids(contacts: DataFrame, ignore_contacts: list[str], ignore_tags: list[str]) -> DataFrame:
    """(id): listed contacts, and contacts with any of the tags."""
    spark = contacts.sparkSession
    own = spark.createDataFrame([(c,) for c in ignore_contacts], "id string")
    tagged = contacts.filter(F.arrays_overlap("labels", F.array(*(F.lit(t) for t in ignore_tags)).cast("array<string>"))) if ignore_tags else contacts.limit(0)
    return own.union(tagged.select(F.col("user_name").alias("id"))).distinct()


def visible(d: DataFrame, hidden: DataFrame, id_col: str = "talker") -> DataFrame:
    """Rows whose talker is not hidden."""
    return d.join(hidden.select(F.col("id").alias(id_col)), id_col, "left_anti")


def _flag(d: DataFrame, hidden: DataFrame, col: str, out: str) -> DataFrame:
    h = hidden.select(F.col("id").alias("__h"), F.lit(True).alias(out))
    return d.join(h, d[col] == h["__h"], "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("__h")


def _hidden_in_group(sender_flag: str) -> Column:
    """A hidden sender in a group that is not hidden itself."""
    return text.is_group(F.col("talker")) & ~F.col("__talker") & F.col(sender_flag)


def drop_hidden_senders(messages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Messages but those of hidden senders in visible groups."""
    d = _flag(_flag(messages, hidden, "talker", "__talker"), hidden, "sender", "__sender")
    return d.filter(~_hidden_in_group("__sender")).select(*messages.columns)


def drop_hidden_members(messages: DataFrame, hidden: DataFrame) -> DataFrame:
    """drop_hidden_senders() of messages whose talkers are all visible, as one anti join."""
    h = hidden.select(F.col("id").alias("__h"))
    return messages.join(h, F.when(text.is_group(F.col("talker")), F.col("sender")) == F.col("__h"), "left_anti")


def project_messages(messages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Drops messages of hidden senders in visible groups, and what quotes there tell of hidden senders (the snippet too, if there is one)."""
    d = _flag(drop_hidden_senders(messages, hidden), hidden, "talker", "__talker")
    return clear_quotes(d, hidden, ~F.col("__talker")).select(*messages.columns)


def clear_quotes(messages: DataFrame, hidden: DataFrame, seen: Column | None = None) -> DataFrame:
    """Messages without what quotes in groups tell of hidden senders; seen: whether the group itself is visible, else all are."""
    quoting = (F.col("content_kind") == "Quote") & text.is_group(F.col("talker")) & (F.lit(True) if seen is None else seen)
    d = messages.withColumn("__from", F.when(quoting, xmltext.quote_sender(F.col("content.raw_xml"))))
    d = _flag(d, hidden, "__from", "__clear")
    less = F.col("content").withField("refer_sender", F.lit(None).cast("string")).withField("refer_content", F.lit(None).cast("string")).withField("raw_xml", F.lit(""))
    d = d.withColumn("content", F.when(F.col("__clear"), less).otherwise(F.col("content")))
    if "snippet" in messages.columns:
        d = d.withColumn("snippet", F.when(F.col("__clear"), snippet(F.col("content_kind"), F.col("content"))).otherwise(F.col("snippet")))
    return d.drop("__from", "__clear")


def media_allowed(messages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Adds media_allowed: false for media of hidden senders in visible groups."""
    d = _flag(_flag(messages, hidden, "talker", "__talker"), hidden, "sender", "__sender")
    return d.withColumn("media_allowed", ~_hidden_in_group("__sender")).drop("__talker", "__sender")


def project_sessions(sessions: DataFrame, hidden: DataFrame) -> DataFrame:
    """Hides summary and last sender of visible groups whose last sender is hidden."""
    d = sessions.withColumn("talker", F.col("username"))
    d = _flag(_flag(d, hidden, "talker", "__talker"), hidden, "last_msg_sender", "__sender").withColumn("__clear", _hidden_in_group("__sender"))
    d = d.withColumn("summary", F.when(F.col("__clear"), S.HIDDEN_SUMMARY).otherwise(F.col("summary")))
    for c in ("last_msg_sender", "last_sender_display_name", "direction"):
        if c in sessions.columns:
            d = d.withColumn(c, F.when(~F.col("__clear"), F.col(c)))
    return d.select(*sessions.columns)
