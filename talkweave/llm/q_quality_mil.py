"""op4: scores all documents for quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.labelled import fold_of
from talkweave.llm.quality_mil import fit
from talkweave.llm.toxicity import score


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scorer = fit(docs, labels, fold_of("doc_id", 5) != 0)
    return score(docs, scorer, 0.3, held_out=fold_of("doc_id", 5).isin(0, -1)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
