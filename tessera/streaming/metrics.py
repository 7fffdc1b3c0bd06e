"""The log of runs as a stream: windows over it, and a sink in which every line counts once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.metrics import METRIC_SCHEMA


def metrics_stream(spark: SparkSession, folder: str, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Runs, failures and tokens by window and operation; rows later than ``late`` are dropped."""
    rows = spark.readStream.schema(METRIC_SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    grouped = rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "operation")
    counted = grouped.agg(F.count(F.lit(1)).alias("operations"), F.count_if(~F.col("success")).alias("failed"), F.sum("total_tokens").alias("total_tokens"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "operation", "operations", "failed", "total_tokens")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Log lines (``value``) as runs, and ``malformed``: the line where it is no JSON object with a time and an operation."""
    row = F.from_json("value", METRIC_SCHEMA + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    read = lines.where("trim(value) <> ''").select("value", row.alias("row"))
    broken = F.col("row").isNull() | F.col("row._broken").isNotNull() | F.col("row.timestamp").isNull() | F.col("row.operation").isNull()
    return read.select("row.*", F.when(F.coalesce(broken, F.lit(True)), F.col("value")).alias("malformed")).drop("_broken")


def batch_writer(sink: str, late: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch so that writing it again changes nothing: each batch has a folder of its own, which it replaces.

    ``sink/runs`` gets the runs, late ones too, with ``late`` set for those that lie behind all earlier batches' newest
    by more than ``late``; ``sink/malformed`` the lines that are none. A batch's lateness depends on earlier batches alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = parsed_lines(batch).persist()
        newest = newest_before(spark, f"{sink}/runs", number)
        behind = F.lit(False) if newest is None else F.col("timestamp") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        good = rows.where("malformed is null").drop("malformed").withColumn("late", behind)
        good.write.mode("overwrite").parquet(f"{sink}/runs/batch={number}")
        rows.where("malformed is not null").select("malformed").write.mode("overwrite").parquet(f"{sink}/malformed/batch={number}")
        rows.unpersist()

    return write


def newest_before(spark: SparkSession, path: str, number: int):
    """The newest time of the batches before ``number``; None where there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("timestamp timestamp, batch int").parquet(path).where(F.col("batch") < number).agg(F.max("timestamp")).first()[0]


def record_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Takes the log files of ``folder`` over into ``sink``, all that are there, and ends.

    Each run goes on where the last one ended; a batch that was cut short is written again over itself.
    """
    lines = spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(batch_writer(sink, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(spark: SparkSession, sink: str) -> DataFrame:
    """All runs in the sink, as the batch summary takes them, with ``late`` and ``batch``."""
    return spark.read.schema(METRIC_SCHEMA + ", late boolean, batch int").parquet(f"{sink}/runs")


def malformed(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema("malformed string, batch int").parquet(f"{sink}/malformed")
