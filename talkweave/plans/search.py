"""Queries of full-text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions.tokens import Options, tokens
from talkweave.operators import search as S
from talkweave.plans.catalog import query
from talkweave.session import shared
from talkweave.sources import adapters as A

#: Where the indexes of this session are, by the folder of their tables.
INDEXES: dict[str, str] = {}
#: Words without stems, which SQL can do too.
EXACT = Options(stemming=False)
TOK = """tok AS (SELECT doc_id, source, lang, text, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^\\x00-\\x7f\\x{2000}-\\x{206f}\\x{2e00}-\\x{2e7f}\\x{3000}-\\x{303f}]'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents)"""
COLUMNS = "source AS talker, lang AS sender, doc_id % 1000 + 1700000000 AS create_time, doc_id AS sort_seq, doc_id AS server_id"


def _phrase(words: list[str]) -> str:
    test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {test})) > 0"


@query(f"SELECT {COLUMNS} FROM documents WHERE contains(lower(text), 'the tion') ORDER BY sort_seq DESC, create_time DESC, server_id DESC LIMIT 100")
def search_scan(spark: SparkSession, root: str) -> DataFrame:
    return S.scan_page(S.scan_search(A.documents(spark, root), "The Tion"), 100).select("talker", "sender", "create_time", "sort_seq", "server_id")


@query(f"WITH {TOK} SELECT {COLUMNS} FROM tok WHERE {_phrase(['of', 'the'])} AND {_phrase(['and'])}")
def search_phrase(spark: SparkSession, root: str) -> DataFrame:
    d = A.documents(spark, root)
    return S.phrase_search(d, "of-the and", options=EXACT, text=F.col("content.text")).select("talker", "sender", "create_time", "sort_seq", "server_id")


@query(f"WITH {TOK} SELECT {COLUMNS} FROM tok WHERE {_phrase(['of', 'the'])} AND {_phrase(['and'])} ORDER BY create_time DESC, sort_seq DESC, server_id DESC LIMIT 40 OFFSET 3")
def search_index(spark: SparkSession, root: str) -> DataFrame:
    # The first search of a session writes the index; later ones read it, as the tables do not change.
    if root not in INDEXES:
        INDEXES[root] = f"{shared(spark)}/index"
        S.stored_index(A.documents(spark, root), INDEXES[root], EXACT)
    docs, postings = S.read_index(spark, INDEXES[root], EXACT) or S.build_index(A.documents(spark, root).limit(0), EXACT)
    return S.index_page(S.indexed_search(docs, postings, "of-the and", EXACT), 40, 3).select("talker", "sender", "create_time", "sort_seq", "server_id")


@query(f"WITH {TOK} SELECT {COLUMNS.replace('doc_id % 1000', 'doc_id % 12 * 2629800')} FROM tok WHERE {_phrase(['of', 'the'])} AND doc_id % 24 <> 5")
def index_refresh(spark: SparkSession, root: str) -> DataFrame:
    """An index over twelve months that is brought up to date: one month's texts are edited, some rows of another recalled."""
    at, k = f"{shared(spark)}/index", F.col("server_id")
    now = A.documents(spark, root).withColumn("create_time", k % 12 * 2629800 + A.EPOCH)
    edited = now.withColumn("content", F.when(k % 12 == 3, A.text_content(F.lit("an older text of the same message"))).otherwise(F.col("content")))
    S.stored_index(edited, at, EXACT)
    docs, postings = S.stored_index(now.filter(k % 24 != 5), at, EXACT)
    return S.indexed_search(docs, postings, "of-the", EXACT).select("talker", "sender", "create_time", "sort_seq", "server_id")


# The words of the corpus that a search for "tioning", for "ered" and for "eres" means: with its stem, or itself a stem.
TIONING = "('tion', 'tioned', 'tionedly', 'tiones', 'tioning', 'tioningeation', 'tioninged', 'tioninger', 'tioningering', 'tioninges', 'tioninging', 'tioningly', 'tionly', 'tionlyed', 'tionlyedly', 'tionlying')"
ERED = "('ere', 'ered', 'eredated', 'eredates', 'eredating', 'eredator', 'eredeable', 'eredeant', 'eredeation', 'ereded', 'erededly', 'ereder', 'eredered', 'eredering', 'erederly', 'eredes', 'ereding', 'eredingly', 'eredly', 'eredlyed', 'eredlying', 'eres', 'ering', 'eringly')"
ERES = "('ere', 'ered', 'eredly', 'eres', 'eresated', 'eresates', 'eresating', 'eresator', 'ereseable', 'ereseant', 'ereseation', 'eresed', 'eresedly', 'ereser', 'eresered', 'eresering', 'ereserly', 'ereses', 'eresing', 'eresingly', 'ering', 'eringly')"


@query(f"WITH {TOK} SELECT {COLUMNS} FROM tok WHERE len(list_filter(w, lambda x: x IN {TIONING})) > 0 AND len(list_filter(w, lambda x: x IN {ERED})) > 0")
def search_stems(spark: SparkSession, root: str) -> DataFrame:
    """With stems, by an index: all forms of both words are found."""
    docs, postings = S.build_index(A.documents(spark, root))
    return S.indexed_search(docs, postings, "tioning ered").select("talker", "sender", "create_time", "sort_seq", "server_id")


@query(f"WITH {TOK} SELECT {COLUMNS} FROM tok WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND w[i + 1] IN {ERES})) > 0")
def search_stem_phrase(spark: SparkSession, root: str) -> DataFrame:
    """With stems, by the words of each row: a phrase of a word and any form of the next."""
    return S.phrase_search(A.documents(spark, root), "the-eres", text=F.col("content.text")).select("talker", "sender", "create_time", "sort_seq", "server_id")


@query(f"""WITH {TOK}, hit AS (SELECT * FROM tok WHERE {_phrase(['of', 'the'])} ORDER BY doc_id % 1000 DESC, doc_id // 7 DESC, doc_id DESC LIMIT 60 OFFSET 2)
SELECT doc_id AS message_local_id, text AS snippet, coalesce(a.s_name, 'unknown:' || doc_id % 150) AS talker, coalesce(b.s_name, 'unknown:' || doc_id % 90) AS sender, 49::BIGINT AS msg_type, (doc_id % 60)::BIGINT AS sub_type
FROM hit LEFT JOIN supplier a ON a.s_suppkey = doc_id % 150 LEFT JOIN supplier b ON b.s_suppkey = doc_id % 90""")
def search_files(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("doc_id")
    d = A.table(spark, root, "documents").select(
        F.col("text").alias("acontent"), k.alias("message_local_id"), F.floor(k / 7).alias("sort_seq"), (k % 1000 + 1700000000).alias("create_time"),
        (k % 150).alias("session_id"), (k % 90).alias("sender_id"), ((k % 60) * 4294967296 + 49).alias("local_type"),
    )
    shards = [d.filter(F.col("message_local_id") % 4 == i) for i in range(4)]
    names = A.table(spark, root, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))
    page = S.file_page(S.file_search(reduce(DataFrame.unionByName, shards), names, "of-the", EXACT), 60, 2)
    return page.select("message_local_id", "snippet", "talker", "sender", "msg_type", "sub_type")


@query(f"WITH {TOK} SELECT x AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(w) AS x FROM tok) GROUP BY x")
def token_counts(spark: SparkSession, root: str) -> DataFrame:
    d = A.documents(spark, root).select("server_id", tokens(F.col("content.text"), EXACT).alias("t"))
    each = d.select("server_id", F.explode(F.flatten("t")).alias("token")).groupBy("token", "server_id").agg(F.count("*").alias("k"))
    return each.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))
