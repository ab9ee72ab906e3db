"""op3: scores all documents for toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.labelled import fold_of
from talkweave.llm.toxicity import fit, score


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scorer = fit(docs, labels, fold_of("doc_id", 3) != 1)
    return score(docs, scorer, 0.7, held_out=fold_of("doc_id", 3).isin(1, -1)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
