"""Message bodies as a tagged union: a kind, and one wide struct whose fields the kind has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.functions import labels, text, wire, xmltext

PLAIN = ("Text", "Emoji", "Location", "System", "Revoke")
# Marks in front of titles in one-line renderings.
MARKS = {"Link": "[链接] ", "File": "[文件] ", "MiniProgram": "[小程序] ", "MergedMessages": "[聊天记录] ", "RedEnvelope": "[红包] ", "ChannelVideo": "[视频号] "}
TRANSFER_MARK, PAT_TEXT, QUOTE_MARK = "[转账] ", "[拍一拍]", "[引用"


def kind(msg_type: Column, sub_type: Column) -> Column:
    app = F.lit("AppGeneric")
    for name in sorted(set(S.APP_KINDS.values())):
        app = F.when(sub_type.isin([k for k, v in S.APP_KINDS.items() if v == name]), name).otherwise(app)
    c = F.when(msg_type == S.APP, app)
    for code, name in S.KINDS.items():
        c = c.when(msg_type == code, name)
    return c.otherwise("Unknown")


def with_content(d: DataFrame, body: str, compressed: str | None = None, packed: str | None = None) -> DataFrame:
    """Adds content_kind and content to rows with msg_type, sub_type and the decoded text column body.

    compressed: bytes that app messages prefer to the body, unless they are damaged. packed: blob with media hashes.
    Steps are columns of their own, so that no expression is repeated inside another."""
    d = d.withColumn("content_kind", kind(F.col("msg_type"), F.col("sub_type")))
    app = F.col("msg_type") == S.APP
    xml = F.when(app, F.coalesce(wire.decode_content(F.col(compressed), F.lit(None).cast("int")), F.col(body)) if compressed else F.col(body))
    d = d.withColumn("__xml", xml)
    x, is_ = F.col("__xml"), lambda *names: F.col("content_kind").isin(list(names))
    info = wire.packed_info(F.col(packed)) if packed else F.lit(None).cast("struct<image_md5: string, video_md5: string>")
    block, quoted = xmltext.quote_parts(x)
    d = d.withColumns({"__block": F.when(is_("Quote"), block), "__quoted": F.when(is_("Quote"), quoted)})
    quote, pay, file = xmltext.quote_fields(x, F.col("__block"), F.col("__quoted")), xmltext.transfer_fields(x), xmltext.file_fields(x)
    d = d.withColumns({
        "__info": info,
        "__title": F.when(app & ~is_("Quote", "Transfer", "Pat"), xmltext.tag_text(x, "title")),
        "__des": F.when(is_("Link", "AppGeneric", "ChannelVideo"), xmltext.shown_text(x, "des")),
        "__url": F.when(is_("Link", "AppGeneric", "MiniProgram"), xmltext.tag_text(x, "url")),
        **{f"__{k}": F.when(is_("Quote"), c) for k, c in quote.items()},
        **{f"__{k}": F.when(is_("Transfer"), c) for k, c in pay.items()},
        **{f"__{k}": F.when(is_("File"), c) for k, c in file.items() if k != "title"},
    })
    shown = xmltext.without(F.col("__title"), "null")
    title = F.when(is_("File"), F.col("__title")).when(is_("ChannelVideo"), F.coalesce(shown, F.col("__des"))).otherwise(shown)
    values = {
        "text": F.when(is_(*PLAIN), F.when(is_("System"), xmltext.system_text(F.col(body))).otherwise(F.col(body))).when(is_("Unknown"), F.col(body)),
        "md5": F.when(is_("Image"), F.col("__info.image_md5")).when(is_("Video"), F.col("__info.video_md5")).otherwise(F.col("__md5")),
        "sub_type": F.when(is_("Link", "MiniProgram", "ChannelVideo", "AppGeneric"), F.col("sub_type")),
        "title": title,
        "des": F.when(is_("Link", "AppGeneric"), F.col("__des")),
        "url": F.col("__url"),
        **{k: F.col(f"__{k}") for k in ("file_ext", "file_size", "reply_text", "refer_sender", "refer_content", "refer_type", "amount_desc", "pay_memo", "pay_sub_type")},
        "raw_xml": x,
        "unknown_type": F.when(is_("Unknown"), F.col("msg_type")),
    }
    made = F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in S.CONTENT.fields))
    return d.withColumn("content", made).drop(*(c for c in d.columns if c.startswith("__")))


def snippet(k: Column, c: Column) -> Column:
    """One-line rendering of a body."""
    full = lambda f: F.coalesce(c[f], F.lit(""))
    reply = full("reply_text")
    quoted = c["refer_sender"].isNotNull() & c["refer_content"].isNotNull()
    out = F.when(k == "Text", full("text"))
    out = out.when(k == "Image", F.concat(F.lit("[image "), full("md5"), F.lit("]"))).when(k == "Video", F.concat(F.lit("[video "), full("md5"), F.lit("]"))).when(k == "Voice", "[voice]")
    for name in ("Emoji", "Location"):
        out = out.when(k == name, F.concat(F.lit(f"[{name.lower()} "), full("text"), F.lit("]")))
    for name in ("System", "Revoke"):
        out = out.when(k == name, F.concat(F.lit(f"[{name.lower()}] "), full("text")))
    for name, mark in MARKS.items():
        out = out.when(k == name, F.concat(F.lit(mark), full("title")))
    out = out.when((k == "Quote") & quoted, F.concat(F.lit(QUOTE_MARK + " @"), c["refer_sender"], F.lit(": "), c["refer_content"], F.lit("] "), reply)).when(k == "Quote", F.concat(F.lit(QUOTE_MARK + "] "), reply))
    out = out.when(k == "Transfer", F.concat(F.lit(TRANSFER_MARK), full("amount_desc"))).when(k == "Pat", PAT_TEXT)
    out = out.when(k == "AppGeneric", F.concat(F.lit("["), labels.app_display_label(c["sub_type"]), F.lit("] "), full("title")))
    return out.otherwise(F.concat(F.lit("[type="), c["unknown_type"].cast("string"), F.lit("]")))


def searchable(k: Column, c: Column) -> Column:
    """Texts of a body that a keyword is looked for in."""
    own = (
        F.when(k.isin(*PLAIN, "Unknown"), F.array(c["text"]))
        .when(k.isin("Link", "AppGeneric"), F.array(c["title"], c["des"]))
        .when(k.isin("File", "MiniProgram", "MergedMessages", "RedEnvelope", "ChannelVideo"), F.array(c["title"]))
        .when(k == "Quote", F.array(c["reply_text"], c["refer_content"]))
        .when(k == "Transfer", F.array(c["amount_desc"], c["pay_memo"]))
    )
    return F.array_compact(F.coalesce(own, F.array().cast("array<string>")))


def matches(texts: Column, keyword: str) -> Column:
    """Whether a text holds the keyword, case aside; the empty keyword is in every text."""
    return F.exists(texts, lambda t: F.lower(t).contains(keyword.lower()))


def index_text(k: Column, c: Column) -> Column:
    """What the search index takes of a body; null for media, system messages and pats."""
    some, fields = xmltext.empty_as_null, xmltext.indexed_fields(c["raw_xml"])
    own = F.when(k.isin("Link", "AppGeneric"), F.concat_ws(" ", c["title"], c["des"])).when(k == "Quote", F.concat_ws(" ", c["reply_text"], c["refer_content"])).otherwise(c["title"])
    return (
        F.when(k.isin("Text", "Emoji", "Location", "Revoke", "Unknown"), c["text"])
        .when(k.isin("Link", "AppGeneric"), some(F.coalesce(some(fields), own)))
        .when(k.isin("File", "MiniProgram", "MergedMessages", "Quote"), some(F.coalesce(some(own), fields)))
        .when(k == "Transfer", some(F.concat_ws(" ", c["amount_desc"], c["pay_memo"])))
        .when(k.isin("RedEnvelope", "ChannelVideo"), c["title"])
    )


def decode(raw: DataFrame, names: DataFrame, talkers: DataFrame) -> DataFrame:
    """Stored rows (schema RAW_MESSAGE) as messages (schema MESSAGE) with `decoded`: false where the body is damaged.

    names: (shard, id, user_name), the shards' sender dictionaries. talkers: (talker), the known conversations; rows of
    tables that belong to none of them are left out. Both joins are on keys, and adaptive execution broadcasts what is small."""
    known = talkers.select("talker", text.table_name(F.col("talker")).alias("table_name")).distinct()
    d = raw.join(known, "table_name").join(names.select("shard", F.col("id").alias("real_sender_id"), "user_name"), ["shard", "real_sender_id"], "left")
    d = d.withColumn("__body", wire.decode_content(F.col("message_content"), F.col("codec")))
    d = d.withColumn("decoded", F.col("__body").isNotNull() | F.col("message_content").isNull())
    d = d.withColumn("__body", F.coalesce("__body", F.lit("")))
    sender, body = text.group_sender(F.col("talker"), F.col("__body"), F.coalesce("user_name", F.lit("")))
    d = d.withColumns({"sender": sender, "body": body, "msg_type": labels.msg_type(F.col("local_type")), "sub_type": labels.sub_type(F.col("local_type"))}).drop("__body")
    d = with_content(d, "body", "compress_content", "packed_info_data")
    return d.select(*(F.col(f.name).cast(f.dataType) for f in S.MESSAGE.fields), "decoded")
