"""Documents to packed training sequences: toxicity, quality rules, near and exact repeats, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's rows and reads them again for the next.

Defined results: null texts are empty ones (not toxic by words, rejected by the quality rules for having too few
words, one group in the near-dedup, nothing to cut, one end token in the packing); rows that repeat an id are told
apart by their texts; a null id is carried through; extra columns, whatever their names, come out as they were;
long texts are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import packing, quality_rules, similar_texts, suffix_dedup, toxicity
from talkweave.llm.common import durable
from talkweave.llm.labelled import fold_of
from talkweave.session import ship


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is one, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labels that op3 may learn from."""
    ship(spark)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_of("doc_id", 3) != 1)
    return toxicity.harmless(docs, scorer, 0.7)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that are frequent on their host."""
    ship(spark)
    return _counted(quality_rules.clean(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group whose five-word shingles have a similarity of 0.8 or more."""
    ship(spark)
    return similar_texts.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has."""
    ship(spark)
    return _counted(suffix_dedup.without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the training sequences."""
    ship(spark)
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: A trained model, shingle hashes and a tokenizer are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
