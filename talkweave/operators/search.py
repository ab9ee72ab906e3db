"""Full-text search: by scan, by tokens of each row, and by an inverted index.

The index is two tables, documents and postings (token, doc, pos), in segments by months. A hot token is not
one task: postings of a query are few tokens' rows, and each phrase is an aggregate by (doc, pos - k)
with map-side combining. With an index a query reads its tokens' postings only."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from os.path import commonprefix

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import labels
from talkweave.functions.content import index_text, matches, searchable
from talkweave.functions.tokens import Options, forms, phrases, pieces, stemmed, words
from talkweave.operators.messages import KEY, ordered
from talkweave.operators.people import name_hits
from talkweave.page import effective_limit

#: Words of a text that go to Python together.
PIECE = 64
INDEX_ORDER = ("create_time", "sort_seq", "server_id")
#: Index files know a row of their own, not the message's id.
FILE_ORDER = ("create_time", "sort_seq", "message_local_id")


def scan_search(messages: DataFrame, keyword: str) -> DataFrame:
    """Messages with the keyword in a searchable text, case aside; the empty keyword is in every such message."""
    return messages.filter(matches(searchable(F.col("content_kind"), F.col("content")), keyword))


def scan_page(hits: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    return hits.orderBy(*ordered(False, KEY)).offset(offset).limit(effective_limit(limit))


def index_page(hits: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    return hits.orderBy(*ordered(False, INDEX_ORDER)).offset(offset).limit(effective_limit(limit))


def phrase_in(position_tokens: Column, phrase: list[list[str]]) -> Column:
    """Whether consecutive positions hold the phrase: at each a token of the text is one of the query's."""
    n = len(phrase)
    at = lambda i: reduce(lambda a, b: a & b, [F.arrays_overlap(F.element_at(position_tokens, i + k), F.array(*(F.lit(t) for t in own))) for k, own in enumerate(phrase)])
    return F.when(F.size(position_tokens) >= n, F.exists(F.sequence(F.lit(1), F.size(position_tokens) - (n - 1)), at)).otherwise(False)


def words_in(words: str, wanted: list[list[list[str]]]) -> Column:
    """Whether a column of words has each of the phrases: consecutive words, at each place one of its forms.

    As text, since a word has up to some thousand forms, and a Column for each takes the driver long. The lambda's variable
    holds the words: pushed below a projection, their expression is still evaluated once a row."""
    own = lambda t: f"'{t}'" if t.isalnum() or not t.isascii() else f"char({ord(t)})"
    held = lambda p: " AND ".join(f"w[i + {k}] IN ({', '.join(map(own, forms))})" for k, forms in enumerate(p))
    each = [f"CASE WHEN size(w) >= {len(p)} THEN exists(sequence(0, size(w) - {len(p)}), i -> {held(p)}) ELSE false END" for p in wanted]
    return F.expr(f"exists(array({words}), w -> {' AND '.join(each)})")


def phrase_search(rows: DataFrame, keyword: str, tokens_col: str = "tokens", options: Options = Options(), text: Column | None = None) -> DataFrame:
    """Rows that hold every word of the keyword as a phrase. No words, or a word without tokens, match nothing.

    text: what the tokens are of, which then need not be there: the query's words are taken in all forms that share a stem with
    them, and compared with the words of the text by built-in functions. Texts that lack what a word's forms begin with are
    left out before they are cut."""
    wanted = phrases(keyword, options)
    if not wanted or not all(wanted):
        return rows.limit(0)
    if text is not None:
        wanted = [[forms(own, options) for own in p] for p in wanted]
        begins = {commonprefix(own) for p in wanted for own in p} - {""}
        # Letters beyond ASCII keep their case.
        rows = rows.filter(reduce(lambda a, b: a & b, [(F.lower(text) if b.isascii() else text).contains(b) for b in sorted(begins)], F.lit(True)))
        return rows.withColumn("__words", words(text, options)).filter(words_in("__words", wanted)).drop("__words")
    # The lambda's variable holds the tokens: pushed below a projection, their expression is still evaluated once a row.
    return rows.filter(F.exists(F.array(F.col(tokens_col)), lambda t: reduce(lambda a, b: a & b, [phrase_in(t, p) for p in wanted])))


def file_search(rows: DataFrame, names: DataFrame, keyword: str, options: Options = Options()) -> DataFrame:
    """Hits among the rows of index files, with codes and names; unknown:<id> where the dictionary lacks one."""
    hits = phrase_search(rows, keyword, options=options, text=F.col("acontent"))
    hits = hits.select(
        F.col("acontent").alias("snippet"), "message_local_id", "sort_seq", "create_time", "session_id", "sender_id",
        labels.msg_type(F.col("local_type")).alias("msg_type"), labels.sub_type(F.col("local_type")).alias("sub_type"), F.lit(0).cast("long").alias("server_id"),
    )
    return name_hits(hits, names).drop("session_id", "sender_id")


def file_page(hits: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    return hits.orderBy(*ordered(False, FILE_ORDER)).offset(offset).limit(effective_limit(limit))


def build_index(messages: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(documents, postings). documents: doc (128 bits of keys and text), talker, sender, the order keys, codes and raw_text of
    messages with a text. Words are cut by built-in functions."""
    d = messages.withColumn("raw_text", index_text(F.col("content_kind"), F.col("content"))).filter("raw_text is not null")
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("talker", *KEY, "sender", "raw_text"))
    docs = d.withColumn("doc", F.unhex(F.md5(F.concat_ws("\1", *parts).cast("binary"))))
    docs = docs.select("doc", "talker", "sender", "create_time", "sort_seq", "server_id", "msg_type", "sub_type", "raw_text")
    return docs, postings_of(docs, options)


def postings_of(docs: DataFrame, options: Options, *beside: str) -> DataFrame:
    """token, doc, pos of the documents' texts, and the columns beside. A word and its stem are found where the text is: no row is dealt out."""
    found = words(F.col("raw_text"), options)
    if not options.stemming:
        return docs.select(*beside, "doc", F.posexplode(found).alias("pos", "token")).select(*beside, "token", "doc", "pos")
    # A text's words go to Python in pieces, so that a batch there is small however long texts are.
    each = docs.select(*beside, "doc", F.posexplode(pieces(found, PIECE)).alias("piece", "words"))
    each = each.select(*beside, "doc", "piece", F.posexplode(stemmed(F.col("words"))).alias("at", "own"))
    return each.select(*beside, F.explode("own").alias("token"), "doc", (F.col("piece") * PIECE + F.col("at")).alias("pos"))


def indexed_search(docs: DataFrame, postings: DataFrame, keyword: str, options: Options = Options()) -> DataFrame:
    """Documents with all phrases, by postings alone, which are read once whatever the number of words."""
    wanted = phrases(keyword, options)
    if not wanted or not all(wanted):
        return docs.limit(0)
    places = [(token, i, len(p), k) for i, p in enumerate(wanted) for k, own in enumerate(p) for token in own]
    asked = postings.sparkSession.createDataFrame(places, "token string, phrase int, n int, k int")
    hits = postings.filter(F.col("token").isin(*{t for t, *_ in places})).join(F.broadcast(asked), "token")
    # A phrase of one word is held anywhere; of others all places from one start on, as bits.
    hits = hits.withColumn("start", F.when(F.col("n") == 1, 0).otherwise(F.col("pos") - F.col("k")))
    cuts = range(0, max(map(len, wanted)), 60)
    bits = [F.bit_or(F.when(F.col("k").between(at, at + 59), F.expr(f"shiftleft(1L, k - {at})")).otherwise(F.lit(0).cast("long"))).alias(f"b{at}") for at in cuts]
    held = hits.groupBy("doc", "phrase", "n", "start").agg(*bits).filter(sum(F.bit_count(f"b{at}") for at in cuts) == F.col("n"))
    found = held.groupBy("doc").agg(F.countDistinct("phrase").alias("phrases")).filter(F.col("phrases") == len(wanted)) if len(wanted) > 1 else held
    return docs.join(found.select("doc"), "doc", "left_semi")


def _month() -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM"), F.lit("none")).alias("month")


def write_segment(docs: DataFrame, root: str, options: Options, part: int = 1 << 24) -> str:
    """Writes documents with their month as a segment of the index, by months; nothing refers to it yet. Its name.

    Texts are dealt in parts of about so many bytes by months, and each part's postings are clustered by token: the postings
    themselves, many times the texts, are dealt to nobody, and a part's few documents are a small dictionary beside them."""
    name = uuid.uuid4().hex
    at, spark = f"{root}/segments/{name}", docs.sparkSession
    docs.write.partitionBy("month").parquet(f"{at}/docs")
    texts = spark.read.schema("doc binary, raw_text string, month string").parquet(f"{at}/docs")
    size = texts.agg(F.sum(F.octet_length("raw_text"))).first()[0] or 0
    texts = texts.repartitionByRange(1 + size // part, "month", "doc")
    postings_of(texts, options, "month").sortWithinPartitions("token").write.parquet(f"{at}/postings")
    return name


def manifest(spark: SparkSession, root: str) -> list[Row]:
    """(month, digest, n, segment, version) of the latest version; one row a month, and one without a month."""
    try:
        d = spark.read.parquet(f"{root}/manifest")
        return d.filter(F.col("version") == d.agg(F.max("version")).first()[0]).collect()
    except AnalysisException:
        return []


def month_digests(messages: DataFrame) -> dict[str, tuple[str, int]]:
    """What each month's index is of: a digest of all its keys, senders and texts, and their number."""
    d = messages.select(_month(), "talker", *KEY, "sender", index_text(F.col("content_kind"), F.col("content")).alias("t")).filter("t is not null")
    own = lambda seed: F.sum(F.xxhash64(F.lit(seed), "talker", *KEY, "sender", "t").cast("decimal(38,0)")).cast("string")
    rows = d.groupBy("month").agg(F.concat_ws("/", own(1), own(2)).alias("digest"), F.count("*").alias("n")).collect()
    return {r.month: (r.digest, r.n) for r in rows}


def stored_index(messages: DataFrame, root: str, options: Options = Options(), most_segments: int = 8) -> tuple[DataFrame, DataFrame]:
    """The index of just these messages below root, brought up to date first.

    Months whose keys or texts are not those that were indexed, by an edit, a recall or a new message, are indexed again
    as one new segment; all others stay in theirs, and months that are gone are left out. Beyond most_segments the
    segments are merged into one. A version is a manifest of months, written after its segments: readers see the old
    or the new one, and a segment that was lost half-way is referred to by none."""
    spark, root = messages.sparkSession, f"{root}/{hashlib.md5(repr(options).encode()).hexdigest()[:8]}"
    found, now = manifest(spark, root), month_digests(messages)
    old = {r.month: r for r in found if r.month is not None}
    changed = [m for m, (digest, _) in now.items() if m not in old or old[m].digest != digest]
    held = {m: (digest, n, old[m].segment if m in old else None) for m, (digest, n) in now.items()}
    if changed:
        name = write_segment(build_index(messages.filter(_month().isin(changed)), options)[0].withColumn("month", _month()), root, options)
        held |= {m: (*now[m], name) for m in changed}
    if len({s for *_, s in held.values()}) > most_segments:
        name = write_segment(_segments(spark, root, {m: s for m, (*_, s) in held.items()})[0], root, options)
        held = {m: (digest, n, name) for m, (digest, n, _) in held.items()}
    if changed or held.keys() != old.keys():
        version = 1 + max((r.version for r in found), default=0)
        rows = [(None,) * 4, *((m, *h) for m, h in held.items())]
        spark.createDataFrame(rows, "month string, digest string, n long, segment string").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return read_index(spark, root.rsplit("/", 1)[0], options) or build_index(messages.limit(0), options)


def _segments(spark: SparkSession, root: str, places: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of the months in their segments, with month."""

    def part(kind: str, schema: str) -> DataFrame:
        by = {}
        for month, segment in places.items():
            by.setdefault(segment, []).append(month)
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{root}/segments/{s}/{kind}").filter(F.col("month").isin(m)) for s, m in sorted(by.items())])

    docs = "doc binary, talker string, sender string, create_time long, sort_seq long, server_id long, msg_type long, sub_type long, raw_text string, month string"
    return part("docs", docs), part("postings", "token string, doc binary, pos int, month string")


def read_index(spark: SparkSession, root: str, options: Options = Options()) -> tuple[DataFrame, DataFrame] | None:
    """(documents, postings) as of the latest version, which is not compared with the messages; None if there is none."""
    root = f"{root}/{hashlib.md5(repr(options).encode()).hexdigest()[:8]}"
    found = {r.month: r.segment for r in manifest(spark, root) if r.month is not None}
    return tuple(d.drop("month") for d in _segments(spark, root, found)) if found else None
