"""op10: encodes and decodes all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.piece_codec import encode


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
