"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, train: Column, per_class: tuple[int, int]) -> DataFrame:
    """At most ``per_class[c]`` training rows of class c, always the same ones, as ``doc_id, label``.

    Rows without an id or a label are left out; a row that is repeated with one label counts once, an id
    with both labels is dropped. The result has at most ``sum(per_class)`` rows, so it may be broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    key = F.xxhash64("doc_id")
    parts = [rows.where(F.col("label") == c).orderBy(key, "doc_id").limit(per_class[c]) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def class_totals(labels: DataFrame, label: str, train: Column) -> dict[int, int]:
    """Rows of each class among all training rows."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy(F.col(label).cast("int").alias("c")).count().collect()
    return {r["c"]: r["count"] for r in rows}
