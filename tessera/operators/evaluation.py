"""Ranking quality and savings of an evaluation run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import MAX_HITS
from tessera.operators.lexical import mask_of


def first_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, rank`` of the first result (``query_id, path, rank``) that is expected; null where none is.

    Where both have ``start_line`` and ``end_line`` the ranges must meet too; an expected path without a range is met anywhere.
    """
    ranged = {"start_line", "end_line"} <= set(results.columns) & set(expected.columns)
    targets = expected.select("query_id", "path", *([F.col("start_line").alias("first"), F.col("end_line").alias("last")] if ranged else [])).distinct()
    met = results.join(targets, ["query_id", "path"])
    if ranged:
        met = met.where(F.col("first").isNull() | (F.col("start_line") <= F.col("last")) & (F.col("first") <= F.col("end_line")))
    hit = met.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(hit, "query_id", "left")


def hit_at_k(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """The share of cases whose first relevant rank is within k, a row a k."""
    rows = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rows.groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("hit_rate"))


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count(F.lit(1)).alias("cases"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """The median (the mean of the two middle values) and the nearest-rank 95th percentile."""
    return values.agg(F.round(F.expr(f"percentile({column}, 0.5)"), 6).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {column})").cast("double").alias("p95"))


def reduction_percent(delivered: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, 0.0).otherwise(F.round(100 * (1 - delivered / baseline), 6))


def compression_ratio(delivered: Column, baseline: Column) -> Column:
    return F.when(delivered == 0, 0.0).otherwise(F.round(baseline / delivered, 6))


def savings(cases: DataFrame) -> DataFrame:
    """Of ``delivered, baseline`` tokens by case: totals, reduction and compression."""
    out = cases.agg(F.sum("delivered").alias("delivered"), F.sum("baseline").alias("baseline"))
    return out.withColumn("reduction_percent", reduction_percent(F.col("delivered"), F.col("baseline"))).withColumn("compression", compression_ratio(F.col("delivered"), F.col("baseline")))


def gate_failures(report: dict[str, float], gate: dict[str, float], slack: float = 1e-9) -> list[str]:
    """The gates that a report misses: ``hit@k`` and ``mrr`` at least, ``avg_tokens`` at most."""
    out = []
    for name, limit in gate.items():
        value = report.get(name, 0.0)
        if name == "avg_tokens" and value > limit + slack or name != "avg_tokens" and value < limit - slack:
            out.append(f"{name}: {value} against {limit}")
    return out


def plain_search_ranking(lines: DataFrame, terms: list[str], per_file: int = 20) -> DataFrame:
    """Files by how many terms, then how many lines, plain search finds: no weights, parts of words count."""
    low = F.lower("line")
    rows = lines.select("path", "line_no", mask_of([low.contains(t.lower()) for t in terms]).alias("mask")).where("mask <> 0")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("n") <= per_file)
    return rows.groupBy("path").agg(F.bit_count(F.expr("bit_or(mask)")).alias("terms"), F.count(F.lit(1)).alias("lines"))


def plain_order(ranked: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """The first ``limit`` of ``ranked`` (``path, terms, lines``) with ``file_rank``: more terms first, then more lines, then by path."""
    order = (F.desc("terms"), F.desc("lines"), F.asc("path"))
    head = ranked.orderBy(*order).limit(limit)
    return head.withColumn("file_rank", F.row_number().over(Window.orderBy(*order)))


def interleave(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """``path, line_no, depth, file_rank``: the best hit of every ranked file (``path, file_rank``), then the second ones, and so on."""
    depth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line_no"))
    return hits.withColumn("depth", depth).join(ranked, "path").select("path", "line_no", "depth", "file_rank").orderBy("depth", "file_rank")


def tokens_at_rank(results: DataFrame) -> DataFrame:
    """``results`` (``query_id, rank, tokens``) with ``total``: what is read up to each rank."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("total", F.sum("tokens").over(upto))


def mean_cost(cases: DataFrame) -> DataFrame:
    """Mean ``tokens`` and ``latency_ms`` of an evaluation's cases, and their number; zeros without cases."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.round(F.coalesce(F.avg("tokens"), F.lit(0.0)), 6).alias("avg_tokens"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"))


def distinct_paths(results: DataFrame) -> DataFrame:
    """``query_id, path, rank``: each path where it first comes, numbered anew."""
    first = results.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
    return first.select("query_id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path")).alias("rank"))


def whole_file_tokens(ranked: DataFrame, files: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """``k, tokens``: what reading the first k ranked files (``query_id, path, rank``) whole takes, over all queries."""
    sized = ranked.join(files.select("path", "tokens"), "path").where(F.col("rank") <= max(ks))
    rows = sized.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return rows.groupBy("k").agg(F.sum("tokens").alias("tokens"))


def drift(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, slack: float = 1e-9) -> DataFrame:
    """The rows of two reports that differ: ``keys, before, after, kind`` (``gone``, ``new`` or ``changed``)."""
    one, two = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__one")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__two"))
    rows = one.join(two, list(keys), "full")
    same = F.col("before").eqNullSafe(F.col("after")) | F.coalesce(F.abs(F.col("before") - F.col("after")) <= slack, F.lit(False))
    kind = F.when(F.col("__two").isNull(), "gone").when(F.col("__one").isNull(), "new").when(~same, "changed")
    return rows.withColumn("kind", kind).where("kind is not null").select(*keys, "before", "after", "kind")
