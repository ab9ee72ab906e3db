"""Queries of sessions, contacts, names, privacy and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import labels, text, xmltext
from talkweave.operators import messages as M
from talkweave.operators import people as P
from talkweave.operators import privacy as V
from talkweave.operators import timeline as T
from talkweave.plans.catalog import query
from talkweave.plans.views import CON, CONV, EVT, LIN, SES, named
from talkweave.session import shared
from talkweave.sources import adapters as A
from talkweave.sources import monthly

OWN = "c7"
HIDDEN = ["u4", "u9@chatroom", "c12", "c33", "c48"]
TAG = "BUILDING"
HID = "hid AS (SELECT unnest(['u4', 'u9@chatroom', 'c12', 'c33', 'c48']) AS id UNION SELECT user_name FROM con WHERE label = 'BUILDING')"


def hidden(spark: SparkSession, root: str) -> DataFrame:
    return V.hidden_ids(A.contacts(spark, root), HIDDEN, [TAG])


@query(f"WITH {EVT}, {SES} SELECT username, sort_timestamp, summary, last_msg_type, last_msg_sender FROM ses ORDER BY sort_timestamp DESC, username LIMIT 20")
def sessions_page(spark: SparkSession, root: str) -> DataFrame:
    return P.sessions_page(A.sessions_of(A.events(spark, root)), 20).drop("last_sender_display_name")


@query(f"WITH {EVT}, {SES} SELECT username, sort_timestamp FROM ses ORDER BY sort_timestamp, username LIMIT 20 OFFSET 15")
def sessions_page_asc(spark: SparkSession, root: str) -> DataFrame:
    return P.sessions_page(A.sessions_of(A.events(spark, root)), 20, 15, True).select("username", "sort_timestamp")


@query(f"WITH {CON} SELECT user_name, alias, remark, nick_name, memo, region, label FROM con WHERE contains(lower(concat_ws(chr(1), user_name, alias, remark, nick_name, memo, region, label)), 'friend') ORDER BY user_name LIMIT 1000")
def contacts_search(spark: SparkSession, root: str) -> DataFrame:
    d = P.contacts_page(A.contacts(spark, root), "FRIEND")
    return d.select("user_name", "alias", "remark", "nick_name", "memo", "region", F.get("labels", F.lit(0)).alias("label"))


@query(f"WITH {CON} SELECT user_name, region FROM con ORDER BY user_name LIMIT 30 OFFSET 40")
def contacts_page(spark: SparkSession, root: str) -> DataFrame:
    return P.contacts_page(A.contacts(spark, root), None, 30, 40).select("user_name", "region")


@query(f"WITH {CON} SELECT n.user_name, name AS display_name, {named('n.user_name')} AS display_with_id, n.avatar_url FROM names n")
def contact_display(spark: SparkSession, root: str) -> DataFrame:
    return P.names(A.contacts(spark, root)).withColumn("display_with_id", text.display_with_id(F.col("display_name"), F.col("user_name")))


@query(f"""WITH {CON} SELECT CASE gender WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS gender,
CASE source_scene WHEN 1 THEN '通过QQ号添加' WHEN 3 THEN '通过微信号添加' WHEN 6 THEN '通过手机号添加' ELSE '场景码 ' || source_scene END AS source, count(*) AS n FROM con GROUP BY ALL""")
def contact_labels(spark: SparkSession, root: str) -> DataFrame:
    d = A.contacts(spark, root)
    return d.groupBy(labels.gender_label(F.col("gender")).alias("gender"), labels.source_scene_label(F.col("source_scene")).alias("source")).agg(F.count("*").alias("n"))


@query(f"""WITH {LIN}, {CON} SELECT talker, sort_seq, create_time, server_id, sender, {named("sender")} AS sender_display_name, CASE WHEN sender = 'c7' THEN 'outgoing' ELSE 'incoming' END AS direction
FROM lin LEFT JOIN names n ON n.user_name = sender""")
def sender_enrich(spark: SparkSession, root: str) -> DataFrame:
    d = A.lines(spark, root).select("talker", *M.KEY, "sender").withColumn("direction", text.direction(F.col("sender"), OWN))
    return P.with_name(d, "sender", P.names(A.contacts(spark, root)), "sender_display_name")


@query("""WITH ids AS (SELECT s_suppkey AS id, s_name AS username FROM supplier)
SELECT l_orderkey AS server_id, coalesce(a.username, 'unknown:' || l_suppkey) AS talker, coalesce(b.username, 'unknown:' || l_partkey) AS sender
FROM lineitem LEFT JOIN ids a ON a.id = l_suppkey LEFT JOIN ids b ON b.id = l_partkey""")
def hit_names(spark: SparkSession, root: str) -> DataFrame:
    ids = A.table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))
    hits = A.table(spark, root, "lineitem").select(F.col("l_orderkey").alias("server_id"), F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("sender_id"))
    return P.name_hits(hits, ids).select("server_id", "talker", "sender")


@query(f"""WITH {EVT}, {SES}, {CON} SELECT username, sort_timestamp, {named("username")} AS display_name, n.avatar_url, CASE WHEN last_msg_sender = 'c7' THEN 'outgoing' ELSE 'incoming' END AS direction
FROM ses LEFT JOIN names n ON n.user_name = username""")
def session_enrich(spark: SparkSession, root: str) -> DataFrame:
    d = P.enrich_sessions(A.sessions_of(A.events(spark, root)), P.names(A.contacts(spark, root)), OWN)
    return d.select("username", "sort_timestamp", "display_name", "avatar_url", "direction")


@query(f"WITH {CON}, {HID} SELECT id FROM hid")
def hidden_by_tag(spark: SparkSession, root: str) -> DataFrame:
    return hidden(spark, root)


@query(f"WITH {EVT}, {SES}, {CON}, {HID} SELECT username, sort_timestamp FROM ses WHERE username NOT IN (SELECT id FROM hid)")
def visible_sessions(spark: SparkSession, root: str) -> DataFrame:
    return V.visible(A.sessions_of(A.events(spark, root)), hidden(spark, root), "username").select("username", "sort_timestamp")


IN_GROUP = "talker LIKE '%@chatroom' AND talker NOT IN (SELECT id FROM hid) AND sender IN (SELECT id FROM hid)"


@query(f"WITH {EVT}, {CON}, {HID} SELECT talker, sort_seq, create_time, server_id, sender FROM evt WHERE NOT ({IN_GROUP})")
def visible_messages(spark: SparkSession, root: str) -> DataFrame:
    return V.project_messages(A.events(spark, root), hidden(spark, root)).select("talker", *M.KEY, "sender")


@query(f"WITH {EVT}, {CON}, {HID} SELECT NOT ({IN_GROUP}) AS media_allowed, count(*) AS n FROM evt GROUP BY ALL")
def media_visibility(spark: SparkSession, root: str) -> DataFrame:
    return V.media_allowed(A.events(spark, root).select("talker", "sender"), hidden(spark, root)).groupBy("media_allowed").agg(F.count("*").alias("n"))


@query(f"""WITH {EVT}, {SES}, {CON}, {HID}, f AS (SELECT *, username LIKE '%@chatroom' AND username NOT IN (SELECT id FROM hid) AND last_msg_sender IN (SELECT id FROM hid) AS h FROM ses)
SELECT username, sort_timestamp, CASE WHEN h THEN '[消息已隐藏]' ELSE summary END AS summary, CASE WHEN NOT h THEN last_msg_sender END AS last_msg_sender,
CASE WHEN NOT h THEN CASE WHEN last_msg_sender = 'c7' THEN 'outgoing' ELSE 'incoming' END END AS direction FROM f""")
def session_redaction(spark: SparkSession, root: str) -> DataFrame:
    d = A.sessions_of(A.events(spark, root)).withColumn("direction", text.session_direction(F.col("last_msg_sender"), OWN))
    return V.project_sessions(d, hidden(spark, root)).select("username", "sort_timestamp", "summary", "last_msg_sender", "direction")


LINE = f"""{EVT}, {SES}, {CON}, {HID}, line AS (
  SELECT talker, {named("talker", "t.name")} AS talker_display_name, sender, {named("sender", "s.name")} AS sender_display_name, CASE WHEN sender = 'c7' THEN 'outgoing' ELSE 'incoming' END AS direction,
    create_time, sort_seq, server_id, msg_type, 0::BIGINT AS sub_type, text AS snippet
  FROM evt LEFT JOIN names t ON t.user_name = talker LEFT JOIN names s ON s.user_name = sender
  WHERE create_time BETWEEN 1704100000 AND 1706000000 AND talker IN (SELECT username FROM ses) AND talker NOT IN (SELECT id FROM hid) AND NOT ({IN_GROUP})
)"""


def _timeline(spark: SparkSession, root: str) -> DataFrame:
    d = A.events(spark, root)
    return T.timeline(d, A.sessions_of(d), 1704100000, 1706000000, hidden=hidden(spark, root))


@query(f"WITH {LINE} SELECT * FROM line ORDER BY create_time DESC, sort_seq DESC, server_id DESC LIMIT 50 OFFSET 20")
def timeline_page(spark: SparkSession, root: str) -> DataFrame:
    return T.timeline_page(_timeline(spark, root), P.names(A.contacts(spark, root)), OWN, hidden(spark, root), 50, 20)


@query(f"WITH {LINE}, n AS (SELECT count(*) AS total FROM line) SELECT line.*, total FROM line, n ORDER BY create_time, sort_seq, server_id LIMIT 40 OFFSET 7")
def timeline_stored(spark: SparkSession, root: str) -> DataFrame:
    """The first rows of a timeline and its total by stored months, of which only those are read that the page needs or the range cuts."""
    d, at, h = A.events(spark, root), shared(spark), hidden(spark, root)
    monthly.write(d, at)
    rows, total = monthly.timeline(spark, at, A.sessions_of(d), 1704100000, 1706000000, None, h, 47, True)
    return T.timeline_page(rows, P.names(A.contacts(spark, root)), OWN, h, 40, 7, True).withColumn("total", F.lit(total).cast("long"))


@query(f"WITH {LINE} SELECT count(*) AS total, count(DISTINCT talker) AS conversations FROM line")
def timeline_totals(spark: SparkSession, root: str) -> DataFrame:
    return T.totals(_timeline(spark, root))


@query(f"""WITH {CONV}, x AS (SELECT server_id, talker, CASE WHEN server_id % 2 = 0 THEN sender || ':' || chr(10) || text ELSE text END AS t, sender FROM conv)
SELECT server_id, CASE WHEN talker LIKE '%@chatroom' AND instr(t, ':' || chr(10)) > 0 THEN substr(t, 1, instr(t, ':' || chr(10)) - 1) ELSE 'nobody' END AS who,
CASE WHEN talker LIKE '%@chatroom' AND instr(t, ':' || chr(10)) > 0 THEN substr(t, instr(t, ':' || chr(10)) + 2) ELSE t END AS said FROM x""")
def group_sender_split(spark: SparkSession, root: str) -> DataFrame:
    t = F.when(F.col("server_id") % 2 == 0, F.concat("sender", F.lit(":\n"), "content.text")).otherwise(F.col("content.text"))
    d = A.conversations(spark, root).select("server_id", "talker", t.alias("t"))
    who, said = text.group_sender(F.col("talker"), F.col("t"), F.lit("nobody"))
    return d.select("server_id", who.alias("who"), said.alias("said"))


def _tag_sql(tag: str) -> str:
    open_, close = f"<{tag}>", f"</{tag}>"
    after = f"substr(html, instr(html, '{open_}') + {len(open_)})"
    raw = f"CASE WHEN instr(html, '{open_}') > 0 AND instr({after}, '{close}') > 0 THEN substr({after}, 1, instr({after}, '{close}') - 1) END"
    out = f"nullif({raw}, '')"
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


@query(f"SELECT page_id, {_tag_sql('title')} AS title, {_tag_sql('p')} AS first_p, {_tag_sql('h1')} AS h1 FROM pages")
def html_fields(spark: SparkSession, root: str) -> DataFrame:
    d = A.table(spark, root, "pages")
    return d.select("page_id", *(xmltext.tag_text(F.col("html"), t).alias(n) for t, n in (("title", "title"), ("p", "first_p"), ("h1", "h1"))))


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') AS name, regexp_matches(split_part(url, '/', 4), '^[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*$') AS account_like FROM pages")
def safe_names(spark: SparkSession, root: str) -> DataFrame:
    d = A.table(spark, root, "pages")
    return d.select("page_id", text.safe_filename(F.col("url")).alias("name"), text.is_account_like(F.split_part("url", F.lit("/"), F.lit(4))).alias("account_like"))
