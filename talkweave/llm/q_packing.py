"""op9: packs all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.packing import pack


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op9_packing": op9_packing}
