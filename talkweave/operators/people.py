"""Sessions, contacts and group rooms: decoding, lists, search and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text, wire
from talkweave.page import effective_limit


def _or_null(d: DataFrame, name: str, kind: str) -> Column:
    """A column that a source may lack."""
    return (F.col(name) if name in d.columns else F.lit(None)).cast(kind)


def decode_sessions(raw: DataFrame) -> DataFrame:
    """Sessions (schema SESSION) with `decoded`: false where the summary is damaged."""
    d = raw.withColumn("__s", wire.decode_content(F.col("summary").cast("binary"), F.lit(None).cast("int")))
    return d.select(
        "username",
        F.col("sort_timestamp").cast("long"),
        text.group_summary(F.col("username"), F.col("__s")).alias("summary"),
        _or_null(d, "last_msg_type", "long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last_msg_type"),
        _or_null(d, "last_msg_sender", "string").alias("last_msg_sender"),
        _or_null(d, "last_sender_display_name", "string").alias("last_sender_display_name"),
        (F.col("__s").isNotNull() | F.col("summary").isNull()).alias("decoded"),
    )


def sessions_page(sessions: DataFrame, limit: int = 0, offset: int = 0, ascending: bool = False) -> DataFrame:
    by = F.col("sort_timestamp").asc() if ascending else F.col("sort_timestamp").desc()
    return sessions.orderBy(by, F.col("username").asc()).offset(offset).limit(effective_limit(limit))


def label_names(raw: DataFrame) -> DataFrame:
    """(label_id, label_name): ids as text, empty ones left out; of several rows of an id the last in order counts."""
    d = raw.select(F.col("label_id_").cast("string").alias("label_id"), F.col("label_name_").alias("label_name"), F.col("sort_order_").alias("o"))
    return d.filter(F.coalesce(F.col("label_id"), F.lit("")) != "").groupBy("label_id").agg(F.max_by("label_name", F.struct("o", "label_name")).alias("label_name"))


def decode_contacts(raw: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Contacts (schema CONTACT): extra buffer decoded, label ids named in their order, unknown ones left out."""
    d = raw.withColumn("__x", wire.extra(_or_null(raw, "extra_buffer", "binary")))
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = d.select(
        F.col("username").alias("user_name"),
        *(full(c).alias(c) for c in ("alias", "remark", "nick_name")),
        text.full(_or_null(d, "description", "string")).alias("memo"),
        *(F.col(f"__x.{c}").alias(c) for c in ("phone", "signature", "region")),
        text.avatar(*(_or_null(d, c, "string") for c in ("small_head_url", "big_head_url"))).alias("avatar_url"),
        "__x.gender",
        "__x.source_scene",
        F.col("__x.label_ids").alias("__ids"),
    )
    if labels is None:
        return d.withColumn("labels", F.array().cast("array<string>")).drop("__ids")
    named = d.select("user_name", F.posexplode("__ids").alias("pos", "label_id")).join(labels, "label_id")
    named = named.groupBy("user_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label_name"))), lambda x: x["label_name"]).alias("labels"))
    return d.drop("__ids").join(named, "user_name", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


FIELDS = ("user_name", "alias", "remark", "nick_name", "memo", "phone", "signature", "region")


def contact_matches(keyword: str, more: tuple[Column, ...] = ()) -> Column:
    """Whether a field or a label of a contact holds the keyword, case aside."""
    texts = F.array_compact(F.concat(F.array(*(F.col(c) for c in FIELDS), *more), F.coalesce("labels", F.array().cast("array<string>"))))
    return F.exists(texts, lambda x: F.lower(x).contains(keyword.lower()))


def contacts_page(contacts: DataFrame, keyword: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    d = contacts if keyword is None else contacts.filter(contact_matches(keyword))
    return d.orderBy("user_name").offset(offset).limit(effective_limit(limit))


def decode_chatrooms(raw: DataFrame) -> DataFrame:
    return raw.select("username", F.coalesce("owner", F.lit("")).alias("owner"), wire.members(F.col("ext_buffer")).alias("members"))


def chatrooms_page(rooms: DataFrame, username: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    d = rooms if username is None else rooms.filter(F.col("username") == username)
    return d.orderBy("username").offset(offset).limit(effective_limit(limit))


def names(contacts: DataFrame) -> DataFrame:
    """(user_name, display_name, avatar_url): what ids are resolved with."""
    shown = text.display_name(F.col("remark"), F.col("nick_name"), F.col("alias"), F.col("user_name"))
    return contacts.select("user_name", shown.alias("display_name"), "avatar_url")


def with_name(d: DataFrame, id_col: str, resolver: DataFrame, out: str, avatar: str | None = None) -> DataFrame:
    """Adds the id's name with the id behind it; ids that nobody has stand alone. Adaptive execution broadcasts a small resolver."""
    r = resolver.select(F.col("user_name").alias("__id"), F.col("display_name").alias("__name"), F.col("avatar_url").alias("__avatar"))
    j = d.join(r, d[id_col] == r["__id"], "left").withColumn(out, text.display_with_id(F.col("__name"), F.col(id_col)))
    return (j.withColumn(avatar, F.col("__avatar")) if avatar else j).drop("__id", "__name", "__avatar")


def enrich_messages(messages: DataFrame, resolver: DataFrame, own: str) -> DataFrame:
    """Adds sender_display_name, direction and snippet."""
    from talkweave.functions.content import snippet

    d = messages.withColumns({"direction": text.direction(F.col("sender"), own), "snippet": snippet(F.col("content_kind"), F.col("content"))})
    return with_name(d, "sender", resolver, "sender_display_name")


def enrich_sessions(sessions: DataFrame, resolver: DataFrame, own: str) -> DataFrame:
    """Adds display_name, avatar_url and direction."""
    return with_name(sessions.withColumn("direction", text.session_direction(F.col("last_msg_sender"), own)), "username", resolver, "display_name", "avatar_url")


def name_hits(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Search hits (session_id, sender_id) with talker and sender from a dictionary (id, username); unknown:<id> if it lacks one."""
    for col, out in (("session_id", "talker"), ("sender_id", "sender")):
        r = ids.select(F.col("id").alias(col), F.col("username").alias("__n"))
        hits = hits.join(r, col, "left").withColumn(out, F.coalesce("__n", F.concat(F.lit("unknown:"), F.col(col).cast("string")))).drop("__n")
    return hits
