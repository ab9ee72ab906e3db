"""Queries of message bodies: stored rows, the variants of a body, and blobs of contacts and rooms.

The driver's tables hold no such bodies, so each query writes them from columns and reads them back with the
library; the SQL tells what must come out from the columns alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from talkweave.functions import content, text, wire
from talkweave.operators import people
from talkweave.plans.catalog import query
from talkweave.plans.views import CONV
from talkweave.sources import adapters as A


@F.pandas_udf(BinaryType())  # a type, not its name, as that needs a session
def zipped(s: pd.Series) -> pd.Series:
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    return s.map(lambda t: None if t is None else pack(t.encode()))


def stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as they are stored, sender dictionary, known talkers) of the conversations table; every other body is compressed."""
    d, none = A.conversations(spark, root), F.lit(None)
    body = F.concat(F.when(text.is_group(F.col("talker")), "member:\n").otherwise(""), F.col("content.text"))
    plain, odd = body.cast("binary"), F.col("sort_seq") % 2 == 1
    raw = d.select(
        F.lit("a").alias("shard"), text.table_name(F.col("talker")).alias("table_name"), "sort_seq", "server_id", F.col("msg_type").alias("local_type"),
        F.when(F.col("sender") == "user", 1).when(F.col("sender") == "assistant", 2).otherwise(9).cast("long").alias("real_sender_id"), "create_time",
        F.when(odd, zipped(body)).otherwise(plain).alias("message_content"), none.cast("binary").alias("packed_info_data"), none.cast("binary").alias("compress_content"),
        F.when(odd, 4).otherwise(0).alias("codec"), F.col("status"),
    )
    names = spark.createDataFrame([("a", 1, "user"), ("a", 2, "assistant"), ("b", 9, "elsewhere")], "shard string, id long, user_name string")
    return raw, names, d.select("talker").distinct()


@query(f"""WITH {CONV} SELECT talker, sort_seq, server_id, CASE WHEN talker LIKE '%@chatroom' THEN 'member' WHEN sender IN ('user', 'assistant') THEN sender ELSE '' END AS sender,
text AS body, 'Text' AS content_kind, true AS decoded FROM conv""")
def stored_messages(spark: SparkSession, root: str) -> DataFrame:
    d = content.decode(*stored(spark, root))
    return d.select("talker", "sort_seq", "server_id", "sender", F.col("content.text").alias("body"), "content_kind", "decoded")


#: Local types of the variants, by the remainder of a key.
CODES = [1, 3, 34, 43, 47, 48, 10000, 10002, *(s << 32 | 49 for s in (5, 6, 33, 19, 57, 2000, 2001, 51, 62, 24)), 77, 999 << 32 | 49]
FIELDS = ("md5", "title", "des", "url", "file_ext", "file_size", "reply_text", "refer_sender", "refer_content", "amount_desc", "pay_memo")


def variants(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all variants, one part each, with content_kind and content."""
    d = A.table(spark, root, "part")
    local = F.element_at(F.array(*(F.lit(c).cast("long") for c in CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int"))
    digest = F.md5(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    refer = tag("refermsg", F.concat(tag("type", F.lit("1")), tag("fromusr", F.lit("x")), tag("displayname", F.col("p_brand")), tag("content", F.col("p_type"))))
    pay = tag("wcpayinfo", F.concat(tag("paysubtype", F.lit("1")), tag("feedesc", F.concat(F.lit("¥"), F.col("p_size").cast("string"))), tag("pay_memo", F.col("p_brand"))))
    xml = F.concat(
        F.lit("<msg><appmsg>"), tag("title", F.concat("p_name", F.lit(" &amp; co"))), tag("des", F.col("p_type")), tag("url", F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))),
        tag("fileext", F.lit("pdf")), tag("totallen", F.col("p_size").cast("string")), tag("md5", digest), refer, pay, F.lit("</appmsg></msg>"),
    )
    msg, sub = local.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(local, 32)
    packed = F.concat(F.unhex(F.lit("1A222220")), digest.cast("binary"), F.unhex(F.lit("22224220")), digest.cast("binary"))
    d = d.select("p_partkey", msg.alias("msg_type"), sub.alias("sub_type"), F.when(msg == 49, xml).otherwise(F.col("p_type")).alias("body"), packed.alias("packed"))
    return content.with_content(d, "body", None, "packed")


PARTS = """v AS (
  SELECT p_partkey, p_partkey % 20 AS k, p_type AS body, p_name || ' & co' AS title, p_name || ' &amp; co' AS raw_title, p_type AS des, p_brand AS brand, '¥' || p_size AS amount, p_size, md5(p_name || p_partkey) AS digest FROM part
), w AS (
  SELECT *, ['Text', 'Image', 'Voice', 'Video', 'Emoji', 'Location', 'System', 'Revoke', 'Link', 'File', 'MiniProgram', 'MergedMessages', 'Quote', 'Transfer', 'RedEnvelope', 'ChannelVideo', 'Pat', 'AppGeneric', 'Unknown', 'AppGeneric'][k + 1] AS kind FROM v
)"""


@query(f"""WITH {PARTS} SELECT p_partkey, kind AS content_kind, CASE kind WHEN 'Text' THEN body WHEN 'Image' THEN '[image ' || digest || ']' WHEN 'Voice' THEN '[voice]' WHEN 'Video' THEN '[video ' || digest || ']'
WHEN 'Emoji' THEN '[emoji ' || body || ']' WHEN 'Location' THEN '[location ' || body || ']' WHEN 'System' THEN '[system] ' || body WHEN 'Revoke' THEN '[revoke] ' || body WHEN 'Link' THEN '[链接] ' || title
WHEN 'File' THEN '[文件] ' || title WHEN 'MiniProgram' THEN '[小程序] ' || title WHEN 'MergedMessages' THEN '[聊天记录] ' || title WHEN 'Quote' THEN '[引用 @' || brand || ': ' || body || '] ' || title
WHEN 'Transfer' THEN '[转账] ' || amount WHEN 'RedEnvelope' THEN '[红包] ' || title WHEN 'ChannelVideo' THEN '[视频号] ' || title WHEN 'Pat' THEN '[拍一拍]' WHEN 'Unknown' THEN '[type=77]'
ELSE CASE WHEN k = 17 THEN '[笔记] ' ELSE '[app type=999] ' END || title END AS snippet FROM w""")
def variant_snippets(spark: SparkSession, root: str) -> DataFrame:
    d = variants(spark, root)
    return d.select("p_partkey", "content_kind", content.snippet(F.col("content_kind"), F.col("content")).alias("snippet"))


@query(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN kind IN ('Image', 'Video', 'File') THEN digest END AS md5,
CASE WHEN kind IN ('Link', 'File', 'MiniProgram', 'MergedMessages', 'RedEnvelope', 'ChannelVideo', 'AppGeneric') THEN title END AS title, CASE WHEN kind IN ('Link', 'AppGeneric') THEN des END AS des,
CASE WHEN kind IN ('Link', 'AppGeneric', 'MiniProgram') THEN 'http://x/' || p_partkey END AS url, CASE WHEN kind = 'File' THEN 'pdf' END AS file_ext, CASE WHEN kind = 'File' THEN p_size::BIGINT END AS file_size,
CASE WHEN kind = 'Quote' THEN title END AS reply_text, CASE WHEN kind = 'Quote' THEN brand END AS refer_sender, CASE WHEN kind = 'Quote' THEN body END AS refer_content,
CASE WHEN kind = 'Transfer' THEN amount END AS amount_desc, CASE WHEN kind = 'Transfer' THEN brand END AS pay_memo FROM w""")
def variant_fields(spark: SparkSession, root: str) -> DataFrame:
    return variants(spark, root).select("p_partkey", *(F.col(f"content.{c}").alias(c) for c in FIELDS))


@query(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN kind IN ('Text', 'Emoji', 'Location', 'System', 'Revoke', 'Unknown') THEN body WHEN kind IN ('Link', 'AppGeneric') THEN title || '|' || des
WHEN kind IN ('File', 'MiniProgram', 'MergedMessages', 'RedEnvelope', 'ChannelVideo') THEN title WHEN kind = 'Quote' THEN title || '|' || body WHEN kind = 'Transfer' THEN amount || '|' || brand ELSE '' END AS searched,
CASE WHEN kind IN ('Text', 'Emoji', 'Location', 'Revoke', 'Unknown') THEN body WHEN kind IN ('Link', 'AppGeneric') THEN raw_title || chr(10) || des WHEN kind IN ('File', 'MiniProgram', 'MergedMessages', 'RedEnvelope', 'ChannelVideo') THEN title
WHEN kind = 'Quote' THEN title || ' ' || body WHEN kind = 'Transfer' THEN amount || ' ' || brand END AS indexed FROM w""")
def variant_texts(spark: SparkSession, root: str) -> DataFrame:
    k, c = F.col("content_kind"), F.col("content")
    return variants(spark, root).select("p_partkey", F.array_join(content.searchable(k, c), "|").alias("searched"), content.index_text(k, c).alias("indexed"))


def field(tag: int, c: Column) -> Column:
    """A protocol-buffer field of a text or of bytes, of under 128 bytes."""
    b = c.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.lit(tag << 3 | 2)), 2 if tag < 16 else 4, "0")) if tag < 16 else F.unhex(F.lit(f"{tag << 3 & 127 | 130:02X}{tag >> 4:02X}")), F.unhex(F.lpad(F.hex(F.octet_length(b)), 2, "0")), b)


def number(tag: int, c: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.lit(tag << 3)), 2, "0")), F.unhex(F.lpad(F.hex(c), 2, "0")))


@query("""SELECT 'c' || c_custkey AS user_name, nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, '') AS memo, '+' || c_custkey AS phone, 'I am ' || c_name AS signature, n_name || ' · ' || r_name AS region,
CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END::BIGINT AS gender, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 END::BIGINT AS source_scene, 'Friends,' || c_mktsegment AS labels,
CASE WHEN c_custkey % 2 = 0 THEN 'http://b/' ELSE 'http://s/' END || c_custkey AS avatar_url
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def contact_extras(spark: SparkSession, root: str) -> DataFrame:
    c, n, r = (A.table(spark, root, t) for t in ("customer", "nation", "region"))
    d = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("c_custkey")
    key = k.cast("string")
    phone = field(14, F.concat(number(1, F.lit(1)), field(2, field(1, F.concat(F.lit("+"), key)))))
    extra = F.concat(number(2, k % 3), field(4, F.concat(F.lit("I am "), "c_name")), field(5, F.col("n_name")), field(7, F.col("r_name")), number(8, k % 7), phone, field(30, F.concat(F.lit(" 7, 99,"), "c_mktsegment")))
    raw = d.select(
        F.concat(F.lit("c"), key).alias("username"), F.lit("").alias("alias"), F.lit(None).cast("string").alias("remark"), F.col("c_name").alias("nick_name"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("description"),
        extra.alias("extra_buffer"), F.when(k % 2 == 1, F.concat(F.lit("http://s/"), key)).otherwise("").alias("small_head_url"), F.concat(F.lit("http://b/"), key).alias("big_head_url"),
    )
    segments = c.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("label_id_"), F.col("c_mktsegment").alias("label_name_"), F.lit(1).alias("sort_order_"))
    names = people.label_names(segments.union(spark.createDataFrame([("7", "Friends", 2), ("", "none", 3)], "label_id_ string, label_name_ string, sort_order_ int")))
    out = people.decode_contacts(raw, names)
    return out.select("user_name", "memo", "phone", "signature", "region", "gender", "source_scene", F.array_join("labels", ",").alias("labels"), "avatar_url")


@query("""SELECT r_name || '@chatroom' AS username, 'n0' AS owner, string_agg('n' || n_nationkey || '=' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '-' END, ',' ORDER BY n_nationkey) AS members
FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def room_members(spark: SparkSession, root: str) -> DataFrame:
    n, r = A.table(spark, root, "nation"), A.table(spark, root, "region")
    own = field(1, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    one = field(1, F.when(F.col("n_nationkey") % 2 == 0, F.concat(own, field(2, F.col("n_name")))).otherwise(own))
    d = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("b")))).alias("all"))
    d = d.select(F.concat("r_name", F.lit("@chatroom")).alias("username"), F.lit("n0").alias("owner"), F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["b"])).alias("ext_buffer"))
    shown = F.transform("members", lambda m: F.concat(m["user_name"], F.lit("="), F.coalesce(m["display_name"], F.lit("-"))))
    return people.chatrooms_page(people.decode_chatrooms(d)).select("username", "owner", F.array_join(shown, ",").alias("members"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN md5(p_name) END AS digest FROM part")
def resource_digests(spark: SparkSession, root: str) -> DataFrame:
    digest = F.md5(F.col("p_name").cast("binary")).cast("binary")
    k = F.col("p_partkey") % 3
    blob = F.when(k == 0, F.concat(F.unhex(F.lit("0801")), F.unhex(F.lit("12220A20")), digest)).when(k == 1, F.concat(F.unhex(F.lit("FF00")), digest)).otherwise(F.lit(b"\x01no digest"))
    return A.table(spark, root, "part").select("p_partkey", wire.md5_in_resource(blob).alias("digest"))
