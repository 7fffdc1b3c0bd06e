"""An index of text blocks by meaning: which files, which blocks, cached vectors, and recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import DENSE_TOP
from tessera.functions.text import is_binary
from tessera.operators.definitions import all_blocks
from tessera.operators.dense import embedded, nearest
from tessera.operators.structure import fixed_windows
from tessera.sources.carriers import lines as lines_of

INDEX_VERSION, INDEX_FILES, INDEX_BLOCKS, INDEX_FILE_BYTES = 1, 4000, 6000, 512_000


def listed_files(files: DataFrame, limit: int | None = INDEX_FILES) -> DataFrame:
    """The first ``limit`` files by path that may be text: what the index may hold; all of them without a limit."""
    named = files.where(~is_binary(F.col("path")))
    return named if limit is None else named.orderBy("path").limit(limit)


def index_blocks(files: DataFrame, most: int | None = INDEX_BLOCKS, max_bytes: int = INDEX_FILE_BYTES, by_definition: bool = False) -> DataFrame:
    """``path, start_line, end_line, text, key``: the blocks of files, by path, until a file begins with ``most`` gathered before it.

    Without ``most`` there is no bound, and no order of files that one task would see. Blocks are windows, or
    definitions where the language is known. Files over ``max_bytes`` are left out; ``text`` is a block's lines without numbers; ``key`` names it in the cache.
    """
    small = files.where(F.octet_length("text") <= max_bytes)
    lines = lines_of(small)
    ranges = all_blocks(small, lines) if by_definition else fixed_windows(lines)
    if most is not None:
        counted = ranges.groupBy("path").agg(F.count(F.lit(1)).alias("blocks"))
        before = F.coalesce(F.sum("blocks").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # rows of at most INDEX_FILES files
        ranges = ranges.join(counted.withColumn("before", before).where(F.col("before") < most).select("path"), "path", "left_semi")
    split = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    rows = ranges.join(small.select("path", split.alias("lines")), "path")
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.select("path", "start_line", "end_line", text.alias("text")).withColumn("key", F.sha2(F.col("text"), 256))


def left_out(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row ``files, indexed, left_out``: how many files the bounds keep from being found by meaning (or have no block)."""
    held = files.select("path").distinct().join(blocks.select("path").distinct().withColumn("held", F.lit(1)), "path", "left")
    return held.agg(F.count(F.lit(1)).alias("files"), F.count("held").alias("indexed"), F.count_if(F.col("held").isNull()).alias("left_out"))


def with_vectors(blocks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, cache: str | None = None) -> DataFrame:
    """``blocks`` with ``embedding``; only texts that the cache (a Parquet table) lacks for this model are embedded, once each."""
    spark: SparkSession = blocks.sparkSession
    texts = blocks.select("key", "text").dropDuplicates(["key"])
    if cache is None:
        vectors = embedded(texts, embed).select("key", "embedding")
        return blocks.join(vectors, "key")
    name = F.sha2(F.concat_ws("/", F.lit(str(INDEX_VERSION)), F.lit(model), "key"), 256)
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = "name string, embedding array<float>"
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    missing = texts.withColumn("name", name).join(known, "name", "left_anti")
    embedded(missing, embed).select("name", "embedding").write.mode("append").parquet(cache)
    return blocks.withColumn("name", name).join(spark.read.schema(schema).parquet(cache).dropDuplicates(["name"]), "name").drop("name")


def recall(vectors: DataFrame, query: list[float], keep: int = DENSE_TOP) -> DataFrame:
    """``path, start_line, end_line, similarity, rank`` of the nearest blocks; ties by path and line. One pass over the vectors."""
    near = nearest(vectors, query, keep, {"path": "string", "start_line": "int", "end_line": "int"})
    best = near.orderBy(F.desc("similarity"), "path", "start_line", "end_line").limit(keep)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "path", "start_line", "end_line")))


def recalled_files(hits: DataFrame) -> DataFrame:
    """``path, place``: each file of the hits once, in the order in which it is first met."""
    first = hits.groupBy("path").agg(F.min("rank").alias("first"))
    return first.select("path", F.row_number().over(Window.orderBy("first")).alias("place"))


def with_recalled(loaded: DataFrame, recalled: DataFrame) -> DataFrame:
    """The loaded files, and the recalled ones that are not among them."""
    return loaded.unionByName(recalled.join(loaded.select("path"), "path", "left_anti"), allowMissingColumns=True)
