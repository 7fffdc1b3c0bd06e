"""Preparing a training corpus from ``documents``: five stages, each an operator of ``tessera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import cut

#: In order; each function takes (spark, docs, sf_dir) and returns the next stage's docs.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("suffix_array_dedup", stages.drop_repeated_strings),
    ("source_mixing", stages.mix_sources),
    ("best_fit_packing", stages.pack_sequences),
]

#: SQL can express neither the classifier nor the mix; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
