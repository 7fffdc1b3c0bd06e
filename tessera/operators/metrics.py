"""The log of runs and its summary."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import suppress
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import classify_error

T = TypeVar("T")

METRIC_SCHEMA = "timestamp timestamp, operation string, success boolean, model string, duration_ms bigint, input_bytes bigint, files bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cost double, fallback boolean, error_kind string, baseline_bytes bigint, delivered_tokens bigint"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; what cannot be read is left out."""
    return spark.read.schema(METRIC_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def record_run(spark: SparkSession, path: str, operation: str, work: Callable[[], tuple[T, dict]], model: str | None = None) -> T:
    """Does ``work`` and appends one line about it: how long it took, and what it says of itself, or the kind of its failure.

    ``work`` returns its result and some of the log's columns (sizes, tokens, cost, ``model``, ``fallback``). A failure
    is logged by a fixed name, never by its message, and goes on to the caller; what cannot be logged is not an error.
    """
    began, at = time.monotonic(), datetime.now(UTC)
    facts: dict = {"input_bytes": 0, "files": 0, "baseline_bytes": 0, "delivered_tokens": 0, "fallback": False}
    message = None
    try:
        result, own = work()
        facts |= own
        return result
    except Exception as error:
        message = str(error)
        facts |= {"fallback": "fallback exhausted" in message}
        raise
    finally:
        facts |= {"timestamp": at, "operation": operation, "success": message is None, "model": facts.get("model") or model, "duration_ms": int((time.monotonic() - began) * 1000)}
        names = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
        with suppress(Exception):
            row = spark.createDataFrame([tuple(facts.get(n) for n in names)], METRIC_SCHEMA)
            append_metrics(row.withColumn("error_kind", F.when(F.lit(message is not None), classify_error(F.lit(message or "")))), path)


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """One row: runs, failures, fallbacks, tokens, cost and what delivery saved against whole files."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = metrics.agg(
        F.count(F.lit(1)).alias("operations"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallbacks"),
        zero("duration_ms").alias("duration_ms"),
        zero("total_tokens").alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
        zero(F.expr("baseline_bytes div 4")).alias("baseline_tokens"),
        zero("delivered_tokens").alias("delivered_tokens"),
    )
    saved = F.greatest(F.col("baseline_tokens") - F.col("delivered_tokens"), F.lit(0))
    percent = F.when(F.col("baseline_tokens") > 0, F.round(100 * saved / F.col("baseline_tokens"), 6)).otherwise(0.0)
    return out.withColumn("saved_tokens", saved).withColumn("saved_percent", percent)
