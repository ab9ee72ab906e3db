"""Messages of all visible conversations in one order of time.

What is hidden is dropped by ids alone; a page is cut before anything is named or rendered, so that only
its rows meet the names, and totals need neither."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.operators.messages import ordered
from talkweave.operators.people import enrich_messages, with_name
from talkweave.operators.privacy import clear_quotes, drop_hidden_members, visible
from talkweave.page import effective_limit

KEY = ("create_time", "sort_seq", "server_id")
COLUMNS = ("talker", "talker_display_name", "sender", "sender_display_name", "direction", "create_time", "sort_seq", "server_id", "msg_type", "sub_type", "snippet")


def known(d: DataFrame, sessions: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Rows (talker, sender and more) of known conversations that hidden ids do not hide. Hidden ids first meet the sessions,
    so the rows meet two tables of ids, of which the plan broadcasts those that are small by their statistics or at run time."""
    talkers = sessions.select(F.col("username").alias("talker"))
    if hidden is None:
        return d.join(talkers, "talker", "left_semi")
    return drop_hidden_members(d.join(visible(talkers, hidden), "talker", "left_semi"), hidden)


def timeline(messages: DataFrame, sessions: DataFrame, since: int, until: int, msg_type: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """All messages of known, visible conversations in [since, until], in no order."""
    if since > until:
        raise ValueError("since must not be after until")
    d = messages.filter(F.col("create_time").between(since, until))
    return known(d if msg_type is None else d.filter(F.col("msg_type") == msg_type), sessions, hidden)


def timeline_page(rows: DataFrame, resolver: DataFrame, own: str, hidden: DataFrame | None = None, limit: int = 0, offset: int = 0, ascending: bool = False) -> DataFrame:
    """A page of timeline(), enriched and without bodies, in order. Only quotes meet the hidden ids again."""
    page = rows.orderBy(*ordered(ascending, KEY)).offset(offset).limit(effective_limit(limit))
    d = enrich_messages(page if hidden is None else clear_quotes(page, hidden), resolver, own)  # rendered once, after the quotes
    return with_name(d, "talker", resolver, "talker_display_name").select(*COLUMNS).orderBy(*ordered(ascending, KEY))


def totals(rows: DataFrame) -> DataFrame:
    """One row: total, conversations."""
    return rows.agg(F.count("*").alias("total"), F.countDistinct("talker").alias("conversations"))
