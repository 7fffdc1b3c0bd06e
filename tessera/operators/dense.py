"""Recall by meaning: nearest vectors of a question, and their fusion with lexical candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import BUDGET_TOKENS, DENSE_MARGIN, DENSE_TOP


def cosines(column: pa.Array, q: np.ndarray) -> np.ndarray:
    """The cosine of each vector with ``q``; 0 for zero vectors, nulls and other lengths."""
    n, flat = len(column), np.zeros((len(column), len(q)))
    same = np.asarray(column.value_lengths().fill_null(0)) == len(q)
    body = np.nan_to_num(np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64))
    if same.any():
        flat[same] = body[np.asarray(column.offsets)[:-1][same][:, None] + np.arange(len(q))]
    norm = np.linalg.norm(flat, axis=1) * float(np.linalg.norm(q))
    return np.divide(flat @ q, norm, out=np.zeros(n), where=norm > 0)


def nearest(vectors: DataFrame, query: list[float], keep: int, ties: dict[str, str]) -> DataFrame:
    """The columns ``ties`` (name and kind) and ``similarity`` of each task's nearest ``keep`` vectors; equal ones in order of those columns."""
    q, order = np.asarray(query, dtype=np.float64), [("similarity", "descending"), *((c, "ascending") for c in ties)]

    def run(batches):
        best = None
        for batch in batches:
            here = pa.table({c: batch.column(c) for c in ties}).append_column("similarity", pa.array(cosines(batch.column("embedding"), q)))
            best = here if best is None else pa.concat_tables([best, here])
            best = best.take(pc.sort_indices(best, sort_keys=order)[:keep])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {k}" for c, k in ties.items())
    return vectors.select(*[F.col(c).cast(k).alias(c) for c, k in ties.items()], "embedding").mapInArrow(run, f"{kinds}, similarity double")


def similarities(vectors: DataFrame, query: list[float], keep: int = DENSE_TOP) -> DataFrame:
    """``vec_id, similarity`` (cosine) of each task's nearest ``keep`` vectors."""
    return nearest(vectors.where("vec_id is not null"), query, keep, {"vec_id": "long"})


def dense_topk(vectors: DataFrame, query: list[float], keep: int = DENSE_TOP) -> DataFrame:
    """The nearest vectors in order; a task hands on no more than ``keep`` of its own."""
    return similarities(vectors, query, keep).orderBy(F.desc("similarity"), "vec_id").limit(keep)


def embedded(blocks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """``blocks`` (``path, start_line, end_line, text``) with vectors from ``embed``, some texts at a time: of no more are there Python objects at once."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                vectors = pa.array(embed(part.column("text").to_pylist()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, "embedding"])

    return blocks.mapInArrow(run, blocks.schema.simpleString()[7:-1].replace(":", " ") + ", embedding array<float>")


def dense_fusion(chunks: DataFrame, hits: DataFrame, budget: int = BUDGET_TOKENS) -> DataFrame:
    """Lexical candidates with at most one dense region per query.

    ``chunks`` and ``hits`` have ``query_id, path, start_line, end_line``, with ``score`` and ``similarity``.
    Without lexical candidates all hits come in by rank. Else the nearest hit's file must lead the next file by
    a relative margin and have no candidate that reaches the second candidate's score; its first region that meets
    no candidate enters with that score, below the top. Where hits have ``estimated_tokens`` or ``line_count``,
    a region over the budget or beyond its file's end does not come in.
    """
    if "estimated_tokens" in hits.columns:
        hits = hits.withColumn("fits", F.col("estimated_tokens") <= budget)
    else:
        hits = hits.withColumn("fits", F.lit(True))
    if "line_count" in hits.columns:
        hits = hits.withColumn("fits", F.col("fits") & (F.col("end_line") <= F.col("line_count")))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path", "start_line")
    per = Window.partitionBy("query_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(per)).withColumn("head", F.first("path").over(order)).withColumn("best", F.max("similarity").over(per))
    other = F.max(F.when(F.col("path") != F.col("head"), F.col("similarity"))).over(per)
    ranked = ranked.withColumn("other", other)
    sure = (F.col("best") > 0) & ~F.isnan("best") & (F.col("other").isNull() | ((F.col("best") - F.col("other")) / F.col("best") >= DENSE_MARGIN))
    lexical = chunks.groupBy("query_id").agg(F.max("score").alias("top"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line"))
    second = chunks.withColumn("place", place).where("place = 2").select("query_id", F.col("score").alias("second"))
    alone = ranked.where("fits").join(lexical, "query_id", "left_anti").select("query_id", "path", "start_line", "end_line", F.greatest(F.lit(1), F.col("n") - F.col("rank") + 1).cast("long").alias("score"))
    head = ranked.where((F.col("path") == F.col("head")) & sure & F.col("fits")).join(lexical, "query_id").join(second, "query_id", "left")
    own = chunks.groupBy("query_id", F.col("path").alias("head")).agg(F.max("score").alias("own"))
    head = head.join(own, ["query_id", "head"], "left").where((F.col("top") > 0) & (F.col("own").isNull() | (F.col("own") < F.coalesce("second", F.col("top")))))
    c = chunks.select(F.col("query_id").alias("cq"), F.col("path").alias("cp"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    free = head.join(c, (F.col("query_id") == F.col("cq")) & (F.col("path") == F.col("cp")) & (F.col("start_line") <= F.col("ce")) & (F.col("cs") <= F.col("end_line")), "left_anti")
    first = free.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("k = 1")
    new = first.select("query_id", "path", "start_line", "end_line", F.least(F.coalesce("second", F.col("top") - 1), F.col("top") - 1).cast("long").alias("score"))
    return chunks.select("query_id", "path", "start_line", "end_line", "score").unionByName(new).unionByName(alone)
