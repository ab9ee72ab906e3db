"""Quality rules: base statistics and cross-document line frequency, as DataFrame operations only.

Base statistics are computed inside each row. The frequency rule hashes normalised lines (lower
case, white space collapsed), counts for each host the distinct documents that hold a line, removes
lines above the limits, and rejects documents of which too little is left.

Distinct documents: copies of one document must not make its own lines look like boilerplate, so
documents are told apart by a fingerprint of all their normalised lines in order, and copies count
once. A line is removed if over `max_docs` distinct documents of its host hold it, however many
copies of them there are and whatever other lines they share.

A hot line or host is no single task: counts are aggregated before the shuffle, and the join back
of frequent lines deals both sides anew, which lets adaptive execution split a hot key.

Defined results: a null text is an empty one; a null host is a host of its own; rows that repeat are
each a document with a result of its own; a null id is carried through; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import columns_of, fresh, record_key, spread_join

SPACES = "[\\x20\\x09-\\x0D]+"
A_WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def line_key(host: Column, line: Column) -> Column:
    """60 bits of the MD5 of a host and a normalised line."""
    named = F.concat(F.coalesce(F.concat(F.lit("h"), host), F.lit("")), F.lit("\n"), F.array_join(words_of(F.lower(line)), " "))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, text, lines (those with a word), keys (of the lines)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(A_WORD)))
    return d.withColumn("keys", F.transform("lines", lambda x: line_key(F.col("host"), x)))


def base_statistics(d: DataFrame, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to columns text and lines."""
    carried = d.columns
    d = d.withColumn("words", words_of(F.col("text")))
    # Windows as hashes: rows without a repeated one, most of them, need no sort.
    d = d.withColumn("hashes", F.when(F.size("words") > window, F.transform(F.sequence(F.lit(1), F.size("words") - (window - 1)), lambda i: F.xxhash64(*(F.element_at("words", i + k) for k in range(window))))))
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, y: F.coalesce(F.get("pairs", y)["h"] == x["h"], F.lit(False))
    d = d.withColumn("spots", F.when(F.col("pairs").isNotNull(), F.array_sort(F.transform(F.filter("pairs", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))))
    # Each repeated window adds the words that the next one does not cover.
    covered = F.aggregate(F.transform("spots", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("spots", i + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10) -> DataFrame:
    """key of the lines above the limit, with n_docs and n_distinct."""
    d = _lines(docs, id_col, text_col, host_col).select(F.array_distinct("keys").alias("own"), F.xxhash64("keys").alias("document"))
    d = d.select(F.explode("own").alias("key"), "document")
    pairs = d.groupBy("key", "document").agg(F.count("*").alias("n"))
    return pairs.groupBy("key").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_distinct")).filter(F.col("n_distinct") > max_docs)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, min_left_words: int = 10, min_left_percent: int = 30, **base) -> DataFrame:
    """One row for each row of docs: doc_id, row_key (128 bits of id, host and text), the base statistics,
    n_removed_lines, n_removed_words, removed (positions among the lines with a word, ascending), kept."""
    frequent = frequent_lines(docs, id_col, text_col, host_col, max_docs)
    d = base_statistics(_lines(docs, id_col, text_col, host_col), **base)
    d = d.withColumn("row", F.monotonically_increasing_id()).withColumn("row_key", record_key(F.col("doc_id"), F.col("host"), F.col("text")))
    stats = ["doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = d.select("row", F.struct(*stats).alias("base"), F.arrays_zip("keys", F.transform("lines", lambda x: F.size(words_of(x))).alias("n")).alias("each"))
    # The statistics travel with a document's first line only; one without lines gets a key that no line has.
    d = d.select("row", "base", F.posexplode_outer("each").alias("pos", "line"))
    d = d.select("row", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("base")).alias("base"), "pos", F.coalesce(F.col("line.keys"), -1 - F.col("row")).alias("key"), F.col("line.n").alias("n"))
    hit = F.col("n_docs").isNotNull()
    joined = spread_join(d, frequent.select("key", "n_docs"), "key", "left")
    out = joined.groupBy("row").agg(
        F.max("base").alias("base"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("n_removed_lines"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long").alias("n_removed_words"),
        F.array_sort(F.collect_list(F.when(hit, F.col("pos")))).alias("removed"),
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_lines") > 0) & ((left < min_left_words) | (100 * left < min_left_percent * F.col("n_words")))
    return out.select("base.*", "n_removed_lines", "n_removed_words", "removed").withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of docs that are kept, without the lines above the limits; other columns as they were.

    Rows that repeat id, host and text get one verdict; rows that repeat an id alone are told apart by the others."""
    key, cut, lines, spots, text = (fresh(c, docs) for c in ("__row", "__removed", "__lines", "__spots", "__text"))
    verdicts = assess(docs, id_col, text_col, host_col, **limits).filter("kept").groupBy(F.col("row_key").alias(key)).agg(F.first("removed").alias(cut))
    d = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    d = d.withColumn(key, record_key(F.col(id_col), F.col(host_col), F.col(text))).join(verdicts.hint("merge"), key).withColumn(lines, F.split(F.col(text), "\n"))
    # Positions count the lines with a word; blank lines stay.
    d = d.withColumn(spots, F.filter(F.transform(F.col(lines), lambda x, i: F.when(x.rlike(A_WORD), i)), lambda i: i.isNotNull()))
    gone = F.transform(F.col(cut), lambda p: F.get(F.col(spots), p))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    return d.withColumn(text_col, F.when(F.size(cut) > 0, left).otherwise(F.col(text_col))).select(*columns_of(docs))
