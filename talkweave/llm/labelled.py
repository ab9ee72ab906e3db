"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.llm.common import durable


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id has fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def bounded_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, rows_per_class: int, bytes_per_class: int, folds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data, label, fold) of labelled rows of each class, in the order of a hash of their ids: at most rows_per_class,
    and as many as have whole texts of at most bytes_per_class in total. fold: their ranks in the class modulo folds.

    usable says which ids (column doc_id) may be learnt from. Ids whose labels differ, and labels that are null or
    neither 0 nor 1, are left out; so are labels without a document, before the bound is applied; of documents that
    repeat an id the least text counts. The ids are few then, so the join with the texts is a broadcast, and the
    driver ranks them: 2 * rows_per_class ids and sizes at most."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    own = own.filter(usable).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    own = durable(own.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi"))
    order = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.col("doc_id"))
    picked = own.filter("label = 0").orderBy(*order).limit(rows_per_class).union(own.filter("label = 1").orderBy(*order).limit(rows_per_class))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    texts = durable(d.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("data").alias("data")))
    rows, held, taken = [], [0, 0], [0, 0]
    for r in texts.select("doc_id", "label", F.octet_length("data").alias("size"), order[0].alias("h")).orderBy("h", "doc_id").collect():
        if held[r.label] + r.size <= bytes_per_class:
            held[r.label] += r.size
            rows.append((r.doc_id, taken[r.label] % folds))
            taken[r.label] += 1
    ranked = docs.sparkSession.createDataFrame(rows, T.StructType([texts.schema["doc_id"], T.StructField("fold", T.IntegerType())]))
    return texts.join(F.broadcast(ranked), "doc_id").select("doc_id", "data", "label", "fold")
