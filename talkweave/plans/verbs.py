"""Queries that go through the store's verbs, and of what stands around them: manifest, media files, exports, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import text
from talkweave.operators import export, export_folder, media, privacy, resolve
from talkweave.operators import people as P
from talkweave.plans.catalog import query
from talkweave.plans.people import HID, HIDDEN, IN_GROUP, OWN, TAG
from talkweave.plans.views import CON, EVT, SES, named
from talkweave.session import shared
from talkweave.sources import adapters as A
from talkweave.sources import manifest
from talkweave.sources.settings import Settings
from talkweave.store import ChatStore


def store(spark: SparkSession, root: str) -> ChatStore:
    d = A.events(spark, root)
    rooms = d.select("talker").distinct().filter(text.is_group(F.col("talker"))).select(F.col("talker").alias("username"), F.lit("c7").alias("owner"), F.array().cast("array<struct<user_name: string, display_name: string>>").alias("members"))
    return ChatStore(d, A.sessions_of(d), A.contacts(spark, root), rooms, OWN, Settings(HIDDEN, [TAG]))


def _page(p, *columns: str) -> DataFrame:
    return p.items.select(*columns)


SHOWN = f"""{EVT}, {SES}, {CON}, {HID}, line AS (
  SELECT evt.*, {named("sender", "s.name")} AS sender_display_name, {named("talker", "t.name")} AS talker_display_name, CASE WHEN sender = 'c7' THEN 'outgoing' ELSE 'incoming' END AS direction, {IN_GROUP} AS gone
  FROM evt LEFT JOIN names s ON s.user_name = sender LEFT JOIN names t ON t.user_name = talker
)"""


@query(f"WITH {EVT}, {SES}, {CON}, {HID} SELECT username, sort_timestamp, {named('username')} AS display_name FROM ses LEFT JOIN names n ON n.user_name = username WHERE username NOT IN (SELECT id FROM hid) ORDER BY sort_timestamp DESC, username LIMIT 20 OFFSET 3")
def store_sessions(spark: SparkSession, root: str) -> DataFrame:
    return _page(store(spark, root).list_sessions(20, 3), "username", "sort_timestamp", "display_name")


@query(f"WITH {CON}, {HID} SELECT user_name, nick_name, region FROM con WHERE contains(lower(concat_ws(chr(1), user_name, alias, remark, nick_name, memo, region, label)), 'remark') AND user_name NOT IN (SELECT id FROM hid) ORDER BY user_name LIMIT 50 OFFSET 2")
def store_contacts(spark: SparkSession, root: str) -> DataFrame:
    return _page(store(spark, root).list_contacts("Remark", 50, 2), "user_name", "nick_name", "region")


@query(f"WITH {EVT} SELECT talker AS username, 'c7' AS owner FROM evt WHERE talker LIKE '%@chatroom' GROUP BY talker ORDER BY talker LIMIT 7 OFFSET 1")
def store_chatrooms(spark: SparkSession, root: str) -> DataFrame:
    return _page(store(spark, root).list_chatrooms(None, 7, 1), "username", "owner")


@query(f"WITH {SHOWN}, page AS (SELECT * FROM line WHERE talker = 'u6@chatroom' AND contains(lower(text), '4') ORDER BY sort_seq, create_time, server_id LIMIT 40 OFFSET 5) SELECT sort_seq, server_id, sender, sender_display_name, direction, text AS snippet FROM page WHERE NOT gone")
def store_history(spark: SparkSession, root: str) -> DataFrame:
    p = store(spark, root).history("u6@chatroom", 40, 5, keyword="4", order="asc")
    return _page(p, "sort_seq", "server_id", "sender", "sender_display_name", "direction", "snippet")


@query(f"WITH {EVT} SELECT count(*) AS total, count_if(contains(lower(text), '4')) AS filtered FROM evt WHERE talker = 'u6@chatroom'")
def history_counts(spark: SparkSession, root: str) -> DataFrame:
    s = store(spark, root)
    total, filtered = (s.history("u6@chatroom", keyword="4", count_filtered=f).total for f in (False, True))
    return spark.createDataFrame([(total, filtered)], "total long, filtered long")


@query(f"WITH {SHOWN} SELECT talker, sort_seq, server_id, sender_display_name, talker_display_name, text AS snippet FROM line WHERE contains(lower(text), '42') AND talker NOT IN (SELECT id FROM hid) ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 30")
def store_search(spark: SparkSession, root: str) -> DataFrame:
    return _page(store(spark, root).search("42", 30, hide=True), "talker", "sort_seq", "server_id", "sender_display_name", "talker_display_name", "snippet")


@query(f"WITH {EVT}, {SES} SELECT 'messages' AS name, count(*) AS n FROM evt UNION ALL SELECT 'sessions', count(*) FROM ses UNION ALL SELECT 'contacts', count(*) FROM customer UNION ALL SELECT 'chatrooms', count(DISTINCT talker) FROM evt WHERE talker LIKE '%@chatroom'")
def table_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(list(store(spark, root).health().items()), "name string, n long")


@query(f"""WITH {CON}, asked AS (SELECT unnest(['wxid_any', 'c12', 'nobody7', 'Customer#000000013', 'REMARK 1495', 'friend', 'no such contact']) AS asked), hits AS (
  SELECT asked, count(user_name) AS n, min(user_name) AS first FROM asked LEFT JOIN con ON contains(lower(concat_ws(chr(1), user_name, alias, remark, nick_name, memo, region, label)), lower(asked)) GROUP BY asked
) SELECT asked, CASE WHEN asked IN ('wxid_any', 'c12', 'nobody7') THEN asked WHEN n = 1 THEN first WHEN n = 0 THEN 'not found' ELSE 'ambiguous' END AS found FROM hits""")
def resolved_names(spark: SparkSession, root: str) -> DataFrame:
    contacts = A.contacts(spark, root).cache()

    def one(name: str) -> str:
        try:
            return resolve.resolve(contacts, name).user_name
        except resolve.NotFound:
            return "not found"
        except resolve.Ambiguous:
            return "ambiguous"

    asked = ["wxid_any", "c12", "nobody7", "Customer#000000013", "REMARK 1495", "friend", "no such contact"]
    return spark.createDataFrame([(a, one(a)) for a in asked], "asked string, found string")


ASKED = """CASE c_custkey % 8 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'remark ' || c_custkey WHEN 2 THEN 'c' || c_custkey WHEN 3 THEN 'al' || c_custkey || '#' WHEN 4 THEN n_name WHEN 5 THEN 'r ' || c_custkey || ' x'
WHEN 6 THEN '#' || right(c_name, 4) ELSE 'http://' || c_custkey || '@chatroom' END"""


@query(f"""WITH {CON}, {HID}, asked AS (SELECT DISTINCT {ASKED} AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey), direct AS (
  SELECT asked, asked LIKE '%@chatroom' OR regexp_full_match(asked, '[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*') AS own FROM asked
), hits AS (
  SELECT asked, own, count(user_name) AS n, min(user_name) AS near FROM direct LEFT JOIN (SELECT * FROM con WHERE user_name NOT IN (SELECT id FROM hid)) c
  ON NOT own AND contains(lower(concat_ws(chr(1), user_name, alias, remark, nick_name, memo, region, label)), lower(asked)) GROUP BY asked, own
), found AS (SELECT *, CASE WHEN own AND asked NOT IN (SELECT id FROM hid) THEN asked WHEN NOT own AND n = 1 THEN near END AS user_name FROM hits)
SELECT asked, CASE WHEN user_name IS NOT NULL THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS outcome, user_name, n FROM found""")
def resolved_table(spark: SparkSession, root: str) -> DataFrame:
    """All names of a table at once, hidden contacts left out."""
    contacts = A.contacts(spark, root)
    asked = A.table(spark, root, "customer").join(A.table(spark, root, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.expr(ASKED).alias("asked"))
    return resolve.resolve_all(contacts, asked, privacy.hidden_ids(contacts, HIDDEN, [TAG])).select("asked", "outcome", "user_name", "n")


@query(f"""WITH {CON}, {HID}, q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'u9@chatroom' ELSE 'u' || o_orderkey % 50 || CASE WHEN o_orderkey % 2 = 0 THEN '@chatroom' ELSE '' END END AS talker, 'c' || o_custkey AS quoted, 'c' || o_orderkey % 1500 AS sender FROM orders),
f AS (SELECT *, talker LIKE '%@chatroom' AND talker NOT IN (SELECT id FROM hid) AS open, quoted IN (SELECT id FROM hid) AS q, sender IN (SELECT id FROM hid) AS s FROM q)
SELECT o_orderkey, CASE WHEN NOT (open AND q) THEN quoted END AS refer_sender, CASE WHEN NOT (open AND q) THEN 'said' END AS refer_content FROM f WHERE NOT (open AND s)""")
def quote_redaction(spark: SparkSession, root: str) -> DataFrame:
    d, k = A.table(spark, root, "orders"), F.col("o_orderkey")
    talker = F.when(k % 3 == 0, "u9@chatroom").otherwise(F.concat(F.lit("u"), (k % 50).cast("string"), F.when(k % 2 == 0, "@chatroom").otherwise("")))
    quoted = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    xml = F.concat(F.lit("<msg><refermsg><chatusr>"), quoted, F.lit("</chatusr><fromusr>room</fromusr></refermsg></msg>"))
    body = F.struct(quoted.alias("refer_sender"), F.lit("said").alias("refer_content"), xml.alias("raw_xml"))
    d = d.select("o_orderkey", talker.alias("talker"), F.concat(F.lit("c"), (k % 1500).cast("string")).alias("sender"), F.lit("Quote").alias("content_kind"), body.alias("content"))
    hidden = privacy.hidden_ids(A.contacts(spark, root), HIDDEN, [TAG])
    return privacy.project_messages(d, hidden).select("o_orderkey", "content.refer_sender", "content.refer_content")


PATHS = "f AS (SELECT '/acc/message/message_' || n_nationkey || '.db' AS path, 100 + n_nationkey AS mtime FROM nation UNION ALL SELECT unnest(['/acc/contact/contact.db', '/acc/session/session.db', '/acc/message/message_fts.db', '/acc/message/media_0.db', '/acc/x/other.db']), 7)"


def _listing(spark: SparkSession, root: str) -> DataFrame:
    own = A.table(spark, root, "nation").select(F.concat(F.lit("/acc/message/message_"), F.col("n_nationkey").cast("string"), F.lit(".db")).alias("path"), (F.col("n_nationkey") + 100).alias("modificationTime"))
    more = spark.createDataFrame([(p, 7) for p in ("/acc/contact/contact.db", "/acc/session/session.db", "/acc/message/message_fts.db", "/acc/message/media_0.db", "/acc/x/other.db")], own.schema)
    return manifest.listing(own.unionByName(more))


@query(f"""WITH {PATHS} SELECT path, CASE WHEN path LIKE '%message_fts.db' THEN 'index' WHEN path LIKE '%contact.db' THEN 'contact' WHEN path LIKE '%session.db' THEN 'session' WHEN path LIKE '%/media_0.db' THEN 'media' WHEN path LIKE '%other.db' THEN 'other' ELSE 'message' END AS category,
try_cast(regexp_extract(path, 'message_([0-9]+)', 1) AS BIGINT) AS shard_id FROM f WHERE path LIKE '%contact.db' OR path LIKE '%session.db' OR path IN ('/acc/message/message_3.db', '/acc/message/message_12.db')""")
def manifest_scope(spark: SparkSession, root: str) -> DataFrame:
    return manifest.in_scope(_listing(spark, root), "shards", shards=[3, 12]).select("path", "category", "shard_id")


@query(f"WITH {PATHS}, s AS (SELECT path, CASE WHEN mtime % 4 = 0 THEN mtime - 1 ELSE mtime END AS mtime FROM f WHERE mtime > 103 OR mtime = 7), d AS (SELECT f.path, f.mtime, s.path IS NOT NULL AS old, f.mtime % 8 = 0 AS bad FROM f LEFT JOIN s ON s.path = f.path AND s.mtime = f.mtime) SELECT count_if(NOT old AND NOT bad)::BIGINT AS ingested, count_if(old)::BIGINT AS skipped, count_if(NOT old AND bad)::BIGINT AS errors FROM d")
def manifest_stats(spark: SparkSession, root: str) -> DataFrame:
    d = _listing(spark, root)
    seen = d.filter("mtime > 103 OR mtime = 7").select("path", F.when(F.col("mtime") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return manifest.stats(d, seen, d.filter("mtime % 8 = 0").select("path"))


TASKS = "t AS (SELECT p_partkey, 's' || p_partkey % 100 AS talker, md5(p_name || p_partkey) AS digest, 1700000000 + p_partkey * 86400 AS create_time FROM part)"


def _tasks(spark: SparkSession, root: str, kind: str) -> DataFrame:
    d, k = A.table(spark, root, "part"), F.col("p_partkey")
    digest = F.md5(F.concat("p_name", k.cast("string")).cast("binary"))
    d = d.select(k.alias("server_id"), F.concat(F.lit("s"), (k % 100).cast("string")).alias("talker"), (k * 86400 + 1700000000).alias("create_time"), F.lit(kind).alias("content_kind"), F.struct(digest.alias("md5"), F.lit("a.txt").alias("title")).alias("content"))
    return media.classify(d)


@query(f"""WITH {TASKS} SELECT p_partkey AS server_id, CASE p_partkey % 4 WHEN 0 THEN '/m/' || md5(talker) || '/2024-01/Img/' || digest || '_h.dat' WHEN 1 THEN '/m/' || md5(talker) || '/2024-01/Img/' || digest || '.dat' WHEN 2 THEN '/m/' || md5(talker) || '/2024-01/Img/' || digest || '_t.dat' END AS path,
CASE WHEN p_partkey % 4 = 2 THEN 'thumbnail' WHEN p_partkey % 4 < 2 THEN 'full' END AS quality FROM t""")
def image_paths(spark: SparkSession, root: str) -> DataFrame:
    tasks = _tasks(spark, root, "Image")
    stem = F.concat(F.lit("/m/"), F.md5(F.col("talker").cast("binary")), F.lit("/2024-01/Img/"), "md5")
    k = F.col("server_id") % 4
    ends = F.when(k == 0, F.array(F.lit("_t"), F.lit("_h"), F.lit(""))).when(k == 1, F.array(F.lit("_t"), F.lit(""))).when(k == 2, F.array(F.lit("_t"))).otherwise(F.array().cast("array<string>"))
    files = tasks.select(F.explode(F.transform(ends, lambda e: F.concat(stem, e, F.lit(".dat")))).alias("path"))
    return media.image_files(tasks, files).select("server_id", "path", "quality")


@query(f"""WITH {TASKS}, m AS (SELECT *, strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM t) SELECT p_partkey AS server_id, CASE p_partkey % 3 WHEN 0 THEN '/v/d1/d2/Video/' || digest || '_n.mp4' WHEN 1 THEN '/v/' || month || '/' || digest || '.mp4' END AS path,
CASE p_partkey % 3 WHEN 0 THEN digest || '_n.mp4' WHEN 1 THEN digest || '.mp4' END AS filename, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fallback_video' ELSE 'skipped_video' END AS tags FROM m""")
def video_paths(spark: SparkSession, root: str) -> DataFrame:
    tasks = _tasks(spark, root, "Video")
    k = F.col("server_id") % 3
    name = F.concat("md5", F.lit("_n.mp4"))
    links = tasks.filter(k == 0).select("md5", name.alias("file_name"), F.lit("d1").alias("dir1"), F.lit("d2").alias("dir2"))
    linked = links.select(F.concat(F.lit("/v/d1/d2/Video/"), "file_name").alias("path"))
    months = tasks.filter(k == 1).select(F.explode(F.array(F.concat(F.lit("/v/"), text.month(F.col("create_time")), F.lit("/"), "md5", F.lit(".mp4")), F.concat(F.lit("/v/2001-01/"), "md5", F.lit(".mp4")))).alias("path"))
    return media.video_files(tasks, links, linked.unionByName(months)).select("server_id", "path", "filename", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey AS server_id, CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_partkey END AS voice FROM part")
def voice_blobs(spark: SparkSession, root: str) -> DataFrame:
    tasks = _tasks(spark, root, "Voice")
    k, key = F.col("server_id"), F.col("server_id").cast("string")
    row = lambda data, db: F.struct(key.alias("svr_id"), data.cast("binary").alias("voice_data"), F.lit(db).alias("db"))
    blobs = tasks.select(F.explode(F.when(k % 2 == 0, F.array(row(F.lit(""), "0"), row(F.concat(F.lit("b"), key), "1"), row(F.lit("later"), "2"))).otherwise(F.array(row(F.lit(""), "0")))).alias("r")).select("r.*")
    return media.voices(tasks, blobs).select("server_id", F.col("voice_data").cast("string").alias("voice"))


@query(f"""WITH {EVT}, k AS (SELECT *, CASE msg_type WHEN 3 THEN 'image' WHEN 49 THEN 'file' END AS kind, strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS d FROM evt WHERE talker = 'u7'),
n AS (SELECT *, row_number() OVER (ORDER BY sort_seq, create_time, server_id) AS position, row_number() OVER (PARTITION BY kind ORDER BY sort_seq, create_time, server_id) AS number, coalesce(d <> lag(d) OVER (ORDER BY sort_seq, create_time, server_id), true) AS stop FROM k)
SELECT position::INT AS position, CASE WHEN stop THEN chr(10) || chr(10) || '—————  ' || strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%-m-%-d') || '  —————' || chr(10) ELSE '' END || chr(10) || CASE WHEN sender = 'c7' THEN 'Me' ELSE sender END || ' ' ||
strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%H:%M') || chr(10) || CASE kind WHEN 'image' THEN '图片' || number || '（可在附件中查看）' WHEN 'file' THEN '文件' || number || '（可在附件中查看）' ELSE text END || chr(10) AS line FROM n""")
def export_lines(spark: SparkSession, root: str) -> DataFrame:
    d = A.events(spark, root).filter("talker = 'u7'")
    kind = F.when(F.col("msg_type") == 3, "image").when(F.col("msg_type") == 49, "file")
    d = d.withColumns({"media_kind": kind, "filename": F.lit("f"), "snippet": F.col("content.text"), "sender_display_name": F.col("sender"), "direction": text.direction(F.col("sender"), "c7")})
    return export.txt_lines(d, "Me").select(F.col("position").cast("int").alias("position"), "line")


@query(f"""WITH {EVT}, {CON}, k AS (SELECT *, CASE WHEN msg_type = 3 AND server_id % 2 = 0 THEN 'voice' END AS kind, strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS d,
  coalesce(s.name, sender) AS shown FROM evt LEFT JOIN names s ON s.user_name = sender WHERE talker = 'u7'),
n AS (SELECT *, row_number() OVER (ORDER BY sort_seq, create_time, server_id) AS position, row_number() OVER (PARTITION BY kind ORDER BY sort_seq, create_time, server_id) AS number, coalesce(d <> lag(d) OVER (ORDER BY sort_seq, create_time, server_id), true) AS stop FROM k),
line AS (SELECT position, CASE WHEN kind = 'voice' THEN chr(10) || '[语音' || number || '] media/' || server_id || '.silk' || chr(10) END AS file, CASE WHEN stop THEN chr(10) || chr(10) || '—————  ' || strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%-m-%-d') || '  —————' || chr(10) ELSE '' END || chr(10) ||
  CASE WHEN sender = 'c7' THEN 'c7x' ELSE {named("sender", "shown")} END || ' ' || strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%H:%M') || chr(10) || CASE WHEN kind = 'voice' THEN '语音' || number || '（可在附件中查看）' WHEN msg_type = 3 THEN '[voice]' ELSE text END || chr(10) AS said FROM n),
made AS (SELECT string_agg(said, '' ORDER BY position) AS said, string_agg(file, '' ORDER BY position) AS files FROM line),
span AS (SELECT count(*) AS n, strftime(to_timestamp(min(create_time)) AT TIME ZONE 'UTC', '%Y-%-m-%-d') AS a, strftime(to_timestamp(max(create_time)) AT TIME ZONE 'UTC', '%Y-%-m-%-d') AS b FROM k)
SELECT 'conversation.txt' AS name, sha256('"c7x"和"u7"的聊天记录如下:' || chr(10) || chr(10) || '导出时间：then' || chr(10) || '消息数：' || n || chr(10) || '时间范围：' || a || ' ~ ' || b || chr(10) || said || coalesce(chr(10) || '附件：' || chr(10) || files, '')) AS digest FROM made, span
UNION ALL SELECT server_id || '.silk', sha256('v' || server_id) FROM k WHERE kind = 'voice'""")
def export_written(spark: SparkSession, root: str) -> DataFrame:
    """A conversation and its voices written to a folder and read back: the digest of the whole text, and of each file."""
    at, (d, files, links, blobs) = shared(spark), _with_voices(spark, root)
    export_folder.write(d, at, export_folder.Names("u7", "u7", "c7x"), "then", "txt", (files, links, blobs))
    parts = export_folder.whole(spark, f"{at}/conversation.txt").agg(F.array_sort(F.collect_list(F.struct("file", "body"))).alias("p"))  # one file for each range of lines
    said = parts.select(F.lit("conversation.txt").alias("name"), F.sha2(F.array_join("p.body", ""), 256).alias("digest"))
    held = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{at}/media")
    return said.unionByName(held.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")))


def _with_voices(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A conversation of the events whose clicks are voices, of which the blobs hold every second one."""
    d = A.events(spark, root).filter("talker = 'u7'").withColumn("content_kind", F.when(F.col("msg_type") == 3, "Voice").otherwise(F.col("content_kind")))
    d = P.enrich_messages(d, P.names(A.contacts(spark, root)), OWN)
    key = F.col("server_id").cast("string")
    blobs = d.filter("content_kind = 'Voice' and server_id % 2 = 0").select(key.alias("svr_id"), F.concat(F.lit("v"), key).cast("binary").alias("voice_data"), F.lit("0").alias("db"))
    return d, spark.createDataFrame([], "path string"), spark.createDataFrame([], "md5 string, file_name string, dir1 string, dir2 string"), blobs


@query(f"""WITH {EVT}, k AS (SELECT *, msg_type = 3 AND server_id % 2 = 0 AS held FROM evt WHERE talker = 'u7')
SELECT row_number() OVER (ORDER BY sort_seq, create_time, server_id) - 1 AS place, server_id, CASE msg_type WHEN 3 THEN '[voice]' ELSE text END AS snippet, CASE WHEN held THEN 'media/' || server_id || '.silk' END AS file, (SELECT count(*) FROM k) AS returned, (SELECT count_if(held) FROM k)::BIGINT AS files FROM k""")
def export_json(spark: SparkSession, root: str) -> DataFrame:
    """The same as JSON, which is read back as one object."""
    at, (d, files, links, blobs) = shared(spark), _with_voices(spark, root)
    export_folder.write(d, at, export_folder.Names("u7", "u7", "c7x"), "then", "json", (files, links, blobs))
    parts = export_folder.whole(spark, f"{at}/conversation.json").agg(F.array_sort(F.collect_list(F.struct("file", "body"))).alias("p"))
    shape = "items array<struct<server_id: long, snippet: string, media_files: array<string>>>, media_files array<string>, paging struct<returned: long>"
    o = parts.select(F.from_json(F.array_join("p.body", ""), shape, {"mode": "FAILFAST"}).alias("o"))
    each = o.select(F.posexplode("o.items").alias("place", "i"), F.col("o.paging.returned").alias("returned"), F.size("o.media_files").cast("long").alias("files"))
    return each.select(F.col("place").cast("long").alias("place"), "i.server_id", "i.snippet", F.col("i.media_files")[0].alias("file"), "returned", "files")


@query(f"""WITH {CON} SELECT user_name, '  ' || rpad(CASE WHEN remark <> '' THEN remark WHEN nick_name <> '' THEN nick_name ELSE '' END || CASE WHEN (remark <> '' OR nick_name <> '') AND alias <> '' THEN ' / ' ELSE '' END || alias, 30, ' ') || ' (' || user_name || ')' AS head
FROM con WHERE length(CASE WHEN remark <> '' THEN remark WHEN nick_name <> '' THEN nick_name ELSE '' END || alias) > 0""")
def contact_heads(spark: SparkSession, root: str) -> DataFrame:
    d = export.contact_lines(A.contacts(spark, root)).select("user_name", F.split("line", "\n")[0].alias("head"))
    return d.filter(~F.col("head").startswith("  ("))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' WHEN 5 THEN 'tif' WHEN 6 THEN 'wxgf' ELSE 'unknown' END AS kind FROM part")
def media_kinds(spark: SparkSession, root: str) -> DataFrame:
    heads = ["FFD8FFE0", "89504E470D0A", "4749463839", "524946460102030457454250", "424D00", "49492A0008", "7778676601", "0102"]
    head = F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return A.table(spark, root, "part").select("p_partkey", text.media_type(F.concat(F.unhex(head), F.col("p_name").cast("binary"))).alias("kind"))


@query("SELECT p_partkey, rtrim(CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' 你 好 ' || p_type ELSE '测 ' || p_type || ' 试' END) AS spaced FROM part")
def cjk_spaces(spark: SparkSession, root: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("你好"), "p_type")).otherwise(F.concat(F.lit("测"), "p_type", F.lit("试")))
    return A.table(spark, root, "part").select("p_partkey", text.cjk_split(t).alias("spaced"))


@query("SELECT p_partkey, p_partkey % 13 BETWEEN 1 AND 12 AS is_month, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS shard_id, CASE WHEN p_partkey % 3 = 0 THEN 'said' ELSE 'x y:' || chr(10) || 'said' END AS summary FROM part")
def names_of_paths(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    month = F.concat(F.lit("2024-"), F.lpad((k % 13).cast("string"), 2, "0"))
    path = F.concat(F.when(k % 2 == 0, "/a/message_").otherwise("/a/biz_"), k.cast("string"), F.lit(".db"))
    said = F.when(k % 3 == 0, "xy:\nsaid").otherwise("x y:\nsaid")
    return A.table(spark, root, "part").select("p_partkey", text.is_month_dir(month).alias("is_month"), text.shard_id(path).alias("shard_id"), text.group_summary(F.lit("g@chatroom"), said).alias("summary"))


@query("SELECT 's' || l_suppkey AS talker, CASE WHEN s_suppkey IS NULL THEN 'unknown:' || l_partkey ELSE s_name END AS sender, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_partkey GROUP BY ALL")
def name_dictionary_join(spark: SparkSession, root: str) -> DataFrame:
    ids = A.table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))
    hits = A.table(spark, root, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("where"), F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("sender_id"))
    return P.name_hits(hits, ids).groupBy(F.col("where").alias("talker"), "sender").agg(F.count("*").alias("n"))
