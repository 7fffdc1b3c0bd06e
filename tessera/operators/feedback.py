"""Pseudo-relevance feedback: identifiers of the leading files that the question did not name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import PRF_FILES, PRF_TERMS
from tessera.functions.text import identifier_tokens


def feedback_terms(files: DataFrame, ranked: DataFrame, searched: list[str], leaders: int = PRF_FILES, limit: int = PRF_TERMS) -> DataFrame:
    """``token, frequency, documents``: the commonest new identifiers of the leading files, none that all of them hold."""
    head = ranked.orderBy(F.desc("score"), "path").limit(leaders)
    few = files.join(F.broadcast(head.select("path")), "path")
    tokens = few.select("path", F.explode(identifier_tokens(F.col("text"))).alias("token"))
    known = [s.lower() for s in searched]
    counted = tokens.where(~F.lower("token").isin(known)).groupBy("token").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("path").alias("documents"))
    rows = counted.crossJoin(head.agg(F.count(F.lit(1)).alias("n")))  # one row
    rows = rows.where("n < 2 or documents < n").drop("n")
    return rows.orderBy(F.desc("frequency"), "documents", F.octet_length("token"), "token").limit(limit)


def evidence_is_weak(hits: DataFrame, terms: int) -> bool:
    """Whether no line but a file's first holds three or more terms that are at least half of all: else feedback would bury a precise match."""
    met = F.bit_count("mask")
    return hits.where((F.col("line_no") > 1) & (met >= 3) & (met * 2 >= terms)).isEmpty()
