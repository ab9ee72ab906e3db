"""A conversation as text lines or JSON, and its summary.

Lines depend on running state (the date before, counters of media), which is computed in ranges of a
conversation (see running), so a long one is many tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text
from talkweave.operators.messages import KEY, ordered
from talkweave.operators.running import running

# Wording of exported texts.
HEADER_GROUP, HEADER_PRIVATE = '"{talker}"的聊天记录如下:', '"{own}"和"{talker}"的聊天记录如下:'
EXPORTED, COUNTED, RANGE = "导出时间：", "消息数：", "时间范围："
ATTACHED, ATTACHMENTS, EMOJI = "（可在附件中查看）", "附件：", "[动画表情]"
MEDIA_LABELS = {"image": "图片", "voice": "语音", "video": "视频", "file": "文件"}


def meta(messages: DataFrame) -> DataFrame:
    """(talker, count, first_time, last_time)."""
    return messages.groupBy("talker").agg(F.count("*").alias("n"), F.min("create_time").alias("first_time"), F.max("create_time").alias("last_time"))


def _dated(messages: DataFrame) -> DataFrame:
    return messages.withColumn("date", F.to_date(F.timestamp_seconds("create_time")))


def _is_break(before: str) -> Column:
    return ~F.coalesce(F.col(before) == F.col("date"), F.lit(False))


def date_breaks(messages: DataFrame) -> DataFrame:
    """Adds date and is_break: whether a message's date differs from the one before it in its conversation."""
    d = running(_dated(messages), ["talker"], ordered(True), previous={"__day": "date"})
    return d.withColumn("is_break", _is_break("__day")).drop("__day")


def counters(messages: DataFrame, kind_col: str = "media_kind") -> DataFrame:
    """Adds number: how many media of its kind there are in the conversation up to each message; null for others."""
    d = running(messages, ["talker", kind_col], ordered(True), rank="number")
    return d.withColumn("number", F.when(F.col(kind_col).isNotNull(), F.col("number")))


def txt_lines(messages: DataFrame, own_name: str, show_emoji: bool = False) -> DataFrame:
    """(position, line) of enriched messages of one conversation; media_kind and filename where a file was written.

    The position, the date before and the counters of media come from one pass over ranges of the conversation."""
    kinds = {f"__{k}": F.col("media_kind") == k for k in MEDIA_LABELS}
    d = running(_dated(messages), ["talker"], ordered(True), "position", kinds, {"__day": "date"})
    label = F.coalesce(*(F.when(F.col("media_kind") == k, F.concat(F.lit(v), F.col(f"__{k}").cast("string"))) for k, v in MEDIA_LABELS.items()))
    body = F.when(F.col("media_kind").isNotNull(), F.concat(label, F.lit(ATTACHED))).when((F.col("content_kind") == "Emoji") & F.lit(not show_emoji), EMOJI).otherwise(F.coalesce("snippet", F.lit("")))
    name = F.when(F.col("direction") == "outgoing", own_name).otherwise(F.coalesce("sender_display_name", F.lit("")))
    dash = "—" * 5
    stop = F.when(_is_break("__day"), F.concat(F.lit(f"\n\n{dash}  "), F.date_format("date", "y-M-d"), F.lit(f"  {dash}\n"))).otherwise("")
    line = F.concat(stop, F.lit("\n"), name, F.lit(" "), text.clock(F.col("create_time"), "HH:mm"), F.lit("\n"), body, F.lit("\n"))
    return d.select("position", line.alias("line"), F.when(F.col("media_kind").isNotNull(), label).alias("label"), "filename")


def txt(messages: DataFrame, talker_name: str, own_name: str, group: bool, exported_at: str, show_emoji: bool = False) -> str:
    """The whole text of one conversation; for pages of bounded size."""
    m = meta(messages).first()
    head = (HEADER_GROUP if group else HEADER_PRIVATE).format(talker=talker_name, own=own_name)
    out = [head, "\n\n", EXPORTED, exported_at, "\n", COUNTED, str(m.n if m else 0), "\n"]
    if m:
        first, last = messages.sparkSession.range(1).select(text.short_date(F.lit(m.first_time)), text.short_date(F.lit(m.last_time))).first()
        out.append(f"{RANGE}{first} ~ {last}\n")
    rows = txt_lines(messages, own_name, show_emoji).orderBy("position").collect()
    out += [r.line for r in rows]
    files = [(r.label, r.filename) for r in rows if r.label]
    if files:
        out.append(f"\n{ATTACHMENTS}\n" + "".join(f"\n[{label}] media/{name}\n" for label, name in files))
    return "".join(out)


def to_json(page, messages: DataFrame, talker: str, talker_name: str, exported_at: str, media: list[str] | None = None) -> str:
    """Export information, conversation summary and the page's envelope."""
    m = meta(messages).first()
    about = {"talker": talker, "display_name": talker_name, "message_count": m.n if m else 0, "first_time": m.first_time if m else None, "last_time": m.last_time if m else None}
    return json.dumps({"export_info": {"exported_at": exported_at}, "conversation": about, **page.to_dict(), "media_files": media or []}, ensure_ascii=False)


def write_lines(messages: DataFrame, own_name: str, path: str) -> None:
    """Lines of one conversation as one text file, in order."""
    txt_lines(messages, own_name).orderBy("position").select("line").coalesce(1).write.mode("overwrite").text(path)


# Wording of one-line renderings.
OWN_SHORT = "我"
SENT_GROUP, FROM_GROUP, FROM_MEMBER, MOVED_GROUP = " 发送到群「", " 来自群「", "」的", " 群消息更新「"
SENT, FROM, MOVED, SAYS = " 发送给", " 来自", " 会话更新「", "："


def bare_name(shown: Column, user: Column) -> Column:
    """A shown name without the id behind it."""
    tail = F.concat(F.lit("（"), user, F.lit("）"))
    return F.when(shown.endswith(tail) & (F.length(shown) > F.length(tail)), F.substr(shown, F.lit(1), F.length(shown) - F.length(tail))).otherwise(shown)


def query_line(messages: DataFrame) -> DataFrame:
    """(order keys, line) of enriched messages: time, who in groups or which way in private, one-line rendering."""
    who = F.when(F.col("direction") == "outgoing", OWN_SHORT).otherwise(bare_name(F.col("sender_display_name"), F.col("sender")))
    mark = F.when(text.is_group(F.col("talker")), F.concat(F.lit("["), who, F.lit("]"))).when(F.col("direction") == "outgoing", ">>").otherwise("<<")
    return messages.select(*KEY, F.concat_ws(" ", text.clock(F.col("create_time")), mark, "snippet").alias("line"))


def search_line(hits: DataFrame) -> DataFrame:
    """(order keys, line) of search hits: time, conversation, in groups the sender, one-line rendering."""
    where, who = bare_name(F.col("talker_display_name"), F.col("talker")), bare_name(F.col("sender_display_name"), F.col("sender"))
    body = F.when(text.is_group(F.col("talker")), F.concat(F.lit("[群「"), where, F.lit("」] "), who, F.lit(": "), "snippet")).otherwise(F.concat(F.lit("["), where, F.lit("] "), "snippet"))
    return hits.select(*KEY, F.concat(text.clock(F.col("create_time")), F.lit("  "), body).alias("line"))


def watch_line(sessions: DataFrame, resolver: DataFrame, at: Column) -> DataFrame:
    """(username, line) of enriched sessions that moved: when it was seen, which way, who, and the summary or the kind of message."""
    from talkweave.functions import labels
    from talkweave.operators.people import with_name

    d = with_name(sessions.withColumn("__sender", F.coalesce("last_msg_sender", F.lit(""))), "__sender", resolver, "__who")
    said = F.coalesce(text.full(F.col("summary")), F.concat(F.lit("["), labels.msg_type_label(F.col("last_msg_type")), F.lit("]")), F.lit(""))
    way, name, end = F.col("direction"), F.col("display_name"), F.lit("」" + SAYS)
    group = (
        F.when(way == "outgoing", F.concat(F.lit(SENT_GROUP), name, end))
        .when((way == "incoming") & (F.col("__sender") != ""), F.concat(F.lit(FROM_GROUP), name, F.lit(FROM_MEMBER), "__who", F.lit(SAYS)))
        .when(way == "incoming", F.concat(F.lit(FROM_GROUP), name, end))
        .otherwise(F.concat(F.lit(MOVED_GROUP), name, end))
    )
    private = F.when(way == "outgoing", F.concat(F.lit(SENT), name, F.lit(SAYS))).when(way == "incoming", F.concat(F.lit(FROM), name, F.lit(SAYS))).otherwise(F.concat(F.lit(MOVED), name, end))
    line = F.concat(text.clock(at, "HH:mm:ss"), F.when(text.is_group(F.col("username")), group).otherwise(private), said)
    return d.select("username", line.alias("line"))


def contact_lines(contacts: DataFrame) -> DataFrame:
    """(user_name, line): name and id, then one branch for each known field."""
    from talkweave.functions import labels

    full = text.full
    alias = F.when(full(F.col("alias")).isNotNull(), F.concat(F.lit(" / "), "alias")).otherwise("")
    name = F.coalesce(full(F.col("remark")), full(F.col("nick_name")))
    shown = F.coalesce(full(F.when(name.isNotNull(), F.concat(name, alias)).otherwise(F.col("alias"))), F.lit(""))
    head = F.when(shown == "", F.concat(F.lit("  ("), "user_name", F.lit(")"))).otherwise(F.concat(F.lit("  "), F.when(F.length(shown) < 30, F.rpad(shown, 30, " ")).otherwise(shown), F.lit(" ("), "user_name", F.lit(")")))
    parts = {"Phone": F.col("phone"), "Signature": F.col("signature"), "Region": F.col("region"), "Gender": labels.gender_label(F.col("gender")), "Source": labels.source_scene_label(F.col("source_scene")), "Memo": F.col("memo"), "Labels": full(F.array_join("labels", ", "))}
    only = {"Gender": F.col("gender"), "Source": F.col("source_scene")}
    branches = F.array_compact(F.array(*(F.when(only.get(k, c).isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in parts.items())))
    tree = F.transform(branches, lambda b, i: F.concat(F.when(i == F.size(branches) - 1, "  └─ ").otherwise("  ├─ "), b))
    return contacts.select("user_name", F.array_join(F.concat(F.array(head), tree), "\n").alias("line"))
