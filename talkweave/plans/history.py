"""Queries of message history: pages, anchors, counts, watermarks, exports, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import labels, text
from talkweave.functions.content import snippet
from talkweave.operators import export, media
from talkweave.operators import messages as M
from talkweave.plans.catalog import query
from talkweave.plans.views import CONV, EVT, LIN
from talkweave.session import shared
from talkweave.sources import adapters as A
from talkweave.sources import monthly

CONV_COLUMNS = ("talker", "sort_seq", "create_time", "server_id", "sender", "snippet")
EVT_COLUMNS = ("talker", "sort_seq", "create_time", "server_id", "sender", "msg_type")


def shown(d: DataFrame) -> DataFrame:
    return d.withColumn("snippet", snippet(F.col("content_kind"), F.col("content"))).select(*CONV_COLUMNS)


@query(f"WITH {CONV} SELECT talker, sort_seq, create_time, server_id, sender, text AS snippet FROM conv WHERE talker = 'conv_3@chatroom' ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 5")
def msg_page_desc(spark: SparkSession, root: str) -> DataFrame:
    return shown(M.page(A.conversations(spark, root), M.MessageQuery(talker="conv_3@chatroom", limit=5)))


@query(f"WITH {EVT} SELECT talker, sort_seq, create_time, server_id, sender, msg_type FROM evt WHERE talker = 'u7' ORDER BY sort_seq, create_time, server_id LIMIT 20 OFFSET 10")
def msg_page_asc_offset(spark: SparkSession, root: str) -> DataFrame:
    return M.page(A.events(spark, root), M.MessageQuery(talker="u7", limit=20, offset=10, ascending=True)).select(*EVT_COLUMNS)


@query(f"WITH {CONV} SELECT talker, sort_seq, create_time, server_id, sender, text AS snippet FROM conv WHERE create_time BETWEEN 1700010000 AND 1700100000 ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 1000")
def msg_time_range(spark: SparkSession, root: str) -> DataFrame:
    return shown(M.page(A.conversations(spark, root), M.MessageQuery(since=1700010000, until=1700100000)))


@query(f"WITH {EVT} SELECT count(*) AS total FROM evt WHERE talker = 'u7' AND msg_type = 49 AND create_time >= 0")
def msg_type_filter_count(spark: SparkSession, root: str) -> DataFrame:
    return M.count_messages(A.events(spark, root), M.MessageQuery(talker="u7", msg_type=labels.parse_msg_type("APP")))


@query(f"WITH {CONV} SELECT talker, sort_seq, create_time, server_id, sender, text AS snippet FROM conv WHERE contains(lower(text), 'tion') ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 50 OFFSET 5")
def msg_keyword(spark: SparkSession, root: str) -> DataFrame:
    return shown(M.page(A.conversations(spark, root), M.MessageQuery(keyword="TION", limit=50, offset=5)))


@query(f"WITH {LIN} SELECT local_type, local_type & 4294967295 AS msg_type, (local_type >> 32) & 4294967295 AS sub_type, count(*) AS n FROM lin GROUP BY ALL")
def local_type_split(spark: SparkSession, root: str) -> DataFrame:
    return A.lines(spark, root).groupBy("local_type", "msg_type", "sub_type").agg(F.count("*").alias("n"))


@query(f"""WITH {LIN} SELECT CASE local_type & 4294967295 WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 34 THEN 'voice' WHEN 49 THEN 'app' WHEN 10000 THEN 'system' ELSE 'unknown' END AS type_label,
CASE WHEN local_type & 4294967295 <> 49 THEN CASE local_type & 4294967295 WHEN 1 THEN 'text' WHEN 3 THEN 'image' WHEN 34 THEN 'voice' WHEN 10000 THEN 'system' ELSE 'unknown' END
ELSE CASE local_type >> 32 WHEN 5 THEN 'link' WHEN 57 THEN 'quote' WHEN 6 THEN 'file' ELSE 'app' END END AS sub_label, count(*) AS n FROM lin GROUP BY ALL""")
def type_label_histogram(spark: SparkSession, root: str) -> DataFrame:
    d = A.lines(spark, root).groupBy("msg_type", "sub_type").agg(F.count("*").alias("n"))  # labels are of few codes
    return d.groupBy(labels.msg_type_label(F.col("msg_type")).alias("type_label"), labels.msg_sub_type_label(F.col("msg_type"), F.col("sub_type")).alias("sub_label")).agg(F.sum("n").alias("n"))


KEYS = "talker, sort_seq, create_time, server_id"


@query(f"""WITH {LIN}, t AS (SELECT {KEYS} FROM lin WHERE talker = 's7'), p AS (SELECT max(sort_seq) AS s FROM t WHERE sort_seq <= 904608000000)
SELECT * FROM (SELECT * FROM t WHERE sort_seq < 904608000000 ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 5) UNION ALL SELECT * FROM t WHERE sort_seq = 904608000000
UNION ALL SELECT * FROM (SELECT * FROM t WHERE sort_seq > 904608000000 ORDER BY sort_seq, create_time, server_id LIMIT 5)""")
def around_seq(spark: SparkSession, root: str) -> DataFrame:
    d = A.lines(spark, root).select("talker", *M.KEY)
    return M.page(d, M.MessageQuery(talker="s7", around_sort_seq=904608000000, context=5))


@query(f"""WITH {CONV}, p AS (SELECT sort_seq, create_time, server_id FROM conv WHERE talker = 'conv_4' AND server_id = 4002),
t AS (SELECT conv.talker, conv.sort_seq, conv.create_time, conv.server_id, (conv.sort_seq, conv.create_time, conv.server_id) < (p.sort_seq, p.create_time, p.server_id) AS b, (conv.sort_seq, conv.create_time, conv.server_id) > (p.sort_seq, p.create_time, p.server_id) AS a FROM conv, p WHERE conv.talker = 'conv_4')
SELECT {KEYS} FROM (SELECT * FROM t WHERE b ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 2) UNION ALL SELECT {KEYS} FROM t WHERE NOT a AND NOT b
UNION ALL SELECT {KEYS} FROM (SELECT * FROM t WHERE a ORDER BY sort_seq, create_time, server_id LIMIT 2)""")
def around_server_id(spark: SparkSession, root: str) -> DataFrame:
    return M.page(A.conversations(spark, root).select("talker", *M.KEY), M.MessageQuery(talker="conv_4", around_server_id=4002, context=2))


@query(f"WITH {EVT} SELECT talker, sort_seq, create_time, server_id, sender, msg_type FROM evt WHERE talker = 'u7' AND msg_type = 3 AND sort_seq > 1704300000000 ORDER BY sort_seq, create_time, server_id LIMIT 15")
def after_seq(spark: SparkSession, root: str) -> DataFrame:
    return M.page(A.events(spark, root), M.MessageQuery(talker="u7", after_sort_seq=1704300000000, msg_type=3, limit=15)).select(*EVT_COLUMNS)


@query(f"""WITH {EVT}, r AS (SELECT *, row_number() OVER (PARTITION BY talker ORDER BY sort_seq, create_time, server_id) AS o FROM evt),
p AS (SELECT talker, sort_seq AS pivot_seq, min(o) AS first, max(o) AS last FROM r GROUP BY talker, sort_seq HAVING count_if(msg_type = 10002) > 0),
w AS (SELECT talker, pivot_seq, unnest(range(first - 2, last + 3)) AS o FROM p)
SELECT talker, pivot_seq, sort_seq, create_time, server_id FROM w JOIN r USING (talker, o)""")
def around_bulk(spark: SparkSession, root: str) -> DataFrame:
    d = A.events(spark, root)
    pivots = d.filter("msg_type = 10002").select("talker", F.col("sort_seq").alias("pivot_seq"))
    return M.around_many(d.select("talker", *M.KEY), pivots, 2).select("talker", "pivot_seq", *M.KEY)


@query(f"WITH {LIN}, known AS (SELECT 's' || s_suppkey AS talker FROM supplier UNION ALL SELECT 'nobody') SELECT k.talker, coalesce(max(sort_seq), 0) AS max_seq FROM known k LEFT JOIN lin ON lin.talker = k.talker GROUP BY k.talker")
def max_seq_per_talker(spark: SparkSession, root: str) -> DataFrame:
    known = A.table(spark, root, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("username"))
    return M.max_seq(A.lines(spark, root), known.union(spark.createDataFrame([("nobody",)], "username string")))


@query(f"WITH {LIN} SELECT coalesce(max(sort_seq), 0) AS watermark FROM lin JOIN supplier ON talker = 's' || s_suppkey")
def global_watermark(spark: SparkSession, root: str) -> DataFrame:
    return M.watermark(A.lines(spark, root), A.table(spark, root, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("username")))


SHARDS = "shards AS (SELECT n_nationkey::BIGINT AS shard_id, CASE WHEN n_nationkey % 6 = 5 THEN 0 ELSE 1700000000 + n_nationkey * 86400 END::BIGINT AS start_time FROM nation)"
RANGES = f"{SHARDS}, ranges AS (SELECT shard_id, start_time, coalesce(lead(start_time) OVER (ORDER BY start_time, shard_id) - 1, 9223372036854775807) AS end_time FROM shards)"


def _shards(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return A.table(spark, root, "nation").select(k.alias("shard_id"), F.when(k % 6 == 5, F.lit(None)).otherwise(k * 86400 + 1700000000).cast("long").alias("start_time"))


@query(f"WITH {RANGES} SELECT * FROM ranges")
def shard_ranges(spark: SparkSession, root: str) -> DataFrame:
    return M.shard_ranges(_shards(spark, root))


@query(f"WITH {RANGES} SELECT * FROM ranges WHERE start_time <= 1700500000 AND end_time >= 1700200000")
def shard_pruning(spark: SparkSession, root: str) -> DataFrame:
    return M.shards_for_range(M.shard_ranges(_shards(spark, root)), 1700200000, 1700500000)


@query(f"WITH {LIN} SELECT talker, count(*) AS n, min(create_time) AS first_time, max(create_time) AS last_time FROM lin GROUP BY talker")
def export_meta(spark: SparkSession, root: str) -> DataFrame:
    return export.meta(A.lines(spark, root))


@query(f"""WITH {EVT} SELECT talker, sort_seq, server_id, d AS date, coalesce(d <> lag(d) OVER (PARTITION BY talker ORDER BY sort_seq, create_time, server_id), true) AS is_break
FROM (SELECT *, strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS d FROM evt)""")
def export_date_breaks(spark: SparkSession, root: str) -> DataFrame:
    return export.date_breaks(A.events(spark, root)).select("talker", "sort_seq", "server_id", F.col("date").cast("string").alias("date"), "is_break")


@query(f"""WITH {EVT}, k AS (SELECT *, CASE msg_type WHEN 3 THEN 'image' WHEN 49 THEN 'file' END AS media_kind FROM evt)
SELECT talker, sort_seq, server_id, media_kind, CASE WHEN media_kind IS NOT NULL THEN count(*) OVER (PARTITION BY talker, media_kind ORDER BY sort_seq, create_time, server_id ROWS UNBOUNDED PRECEDING) END AS number FROM k""")
def export_counters(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("msg_type") == 3, "image").when(F.col("msg_type") == 49, "file")
    return export.counters(A.events(spark, root).withColumn("media_kind", kind)).select("talker", "sort_seq", "server_id", "media_kind", "number")


@query(f"""WITH {CONV} SELECT sort_seq, create_time, server_id, strftime(to_timestamp(create_time) AT TIME ZONE 'UTC', '%m-%d %H:%M') || ' ' ||
CASE WHEN talker LIKE '%@chatroom' THEN '[' || CASE WHEN sender = 'user' THEN '我' ELSE sender END || ']' WHEN sender = 'user' THEN '>>' ELSE '<<' END || ' ' || text AS line FROM conv""")
def query_lines(spark: SparkSession, root: str) -> DataFrame:
    d = A.conversations(spark, root)
    return export.query_line(d.withColumns({"snippet": snippet(F.col("content_kind"), F.col("content")), "sender_display_name": F.col("sender"), "direction": text.direction(F.col("sender"), "user")}))


MEDIA = f"""{LIN}, task AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'img:' || l_partkey WHEN 'N' THEN 'voi:' || server_id ELSE 'vid:' || l_partkey || ':' || create_time END AS task_key FROM lin
), first AS (SELECT task_key, sort_seq AS cs, create_time AS cc, server_id AS ci FROM (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY sort_seq, create_time, server_id) AS o FROM task) WHERE o = 1)"""


def _tasks(spark: SparkSession, root: str) -> DataFrame:
    f, none = F.col("l_returnflag"), F.lit(None)
    kind = F.when(f == "A", "Image").when(f == "N", "Voice").otherwise("Video")
    content = F.struct(F.when(f != "N", F.col("l_partkey").cast("string")).alias("md5"), none.cast("string").alias("title"))
    return media.classify(A.lines(spark, root).withColumns({"content_kind": kind, "content": content}))


@query(f"""WITH {MEDIA} SELECT task_key, count(*) AS n, min(cs) AS first_seq, min(ci) AS first_id, sum(CASE WHEN (sort_seq, create_time, server_id) <> (cs, cc, ci) THEN 1 ELSE 0 END)
  + greatest(sum(CASE WHEN (sort_seq, create_time, server_id) = (cs, cc, ci) THEN 1 ELSE 0 END) - 1, 0) AS n_dup FROM task JOIN first USING (task_key) GROUP BY task_key""")
def media_dedup(spark: SparkSession, root: str) -> DataFrame:
    d = media.with_canonical(_tasks(spark, root))
    return d.groupBy("task_key").agg(F.count("*").alias("n"), F.min("canonical.sort_seq").alias("first_seq"), F.min("canonical.server_id").alias("first_id"), F.sum(F.col("is_dup").cast("long")).alias("n_dup"))


@query(f"""WITH {MEDIA}, o AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY sort_seq, create_time, server_id) > 1 AS is_dup FROM task),
t AS (SELECT is_dup, CASE l_returnflag WHEN 'A' THEN 'thumbnail_image' WHEN 'N' THEN 'silk_voice' ELSE 'skipped_video' END AS tag FROM o)
SELECT tag, count(*) AS n FROM t WHERE NOT is_dup OR tag <> 'thumbnail_image' GROUP BY tag""")
def media_tag_stats(spark: SparkSession, root: str) -> DataFrame:
    tag = F.when(F.col("media_kind") == "image", "thumbnail_image").when(F.col("media_kind") == "voice", "silk_voice").otherwise("skipped_video")
    return media.tag_stats(media.with_canonical(_tasks(spark, root)).withColumn("tags", F.array(tag)))


@query(f"""WITH {LIN} SELECT talker, 'Msg_' || md5(talker) AS table_name, strftime(to_timestamp(max(create_time)) AT TIME ZONE 'UTC', '%Y-%m') AS last_month, count(*) AS n FROM lin GROUP BY talker""")
def table_names(spark: SparkSession, root: str) -> DataFrame:
    d = A.lines(spark, root).groupBy("talker").agg(F.max("create_time").alias("t"), F.count("*").alias("n"))
    return d.select("talker", text.table_name(F.col("talker")).alias("table_name"), text.month(F.col("t")).alias("last_month"), "n")


@query(f"""WITH {LIN}, seen AS (SELECT * FROM lin WHERE talker <> 's3' AND NOT (talker LIKE '%@chatroom' AND sender = 'c5'))
SELECT * FROM (SELECT 'latest' AS page, {KEYS} FROM seen WHERE talker = 's7' ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 40 OFFSET 15)
UNION ALL SELECT * FROM (SELECT 'first' AS page, {KEYS} FROM seen WHERE talker = 's8' AND local_type = 3 AND create_time >= 730000000 ORDER BY sort_seq, create_time, server_id LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'all' AS page, {KEYS} FROM seen ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 300)
UNION ALL SELECT * FROM (SELECT 'after' AS page, {KEYS} FROM seen WHERE talker = 's9' AND sort_seq > 800000000000 ORDER BY sort_seq, create_time, server_id LIMIT 30)""")
def stored_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of a store by months: each reads the months that its counts say it needs."""
    at, hidden = shared(spark), spark.createDataFrame([("s3",), ("c5",)], "id string")
    monthly.write(A.lines(spark, root).select("talker", "sender", "msg_type", *M.KEY), at)
    asked = {
        "latest": M.MessageQuery(talker="s7", limit=40, offset=15),
        "first": M.MessageQuery(talker="s8", msg_type=3, since=730000000, ascending=True, limit=25),
        "all": M.MessageQuery(limit=300),
        "after": M.MessageQuery(talker="s9", after_sort_seq=800000000000, limit=30),
    }
    first, *more = (monthly.page(spark, at, q, hidden).select(F.lit(k).alias("page"), "talker", *M.KEY) for k, q in asked.items())
    for d in more:
        first = first.unionByName(d)
    return first
