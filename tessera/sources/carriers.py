"""The provided tables as the shapes that the engine works on: files, lines, changes, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

PATH = "concat(source, '/doc_', doc_id, case lang when 'en' then '.rs' when 'fr' then '.py' when 'es' then '.md' else '.config.js' end)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, doc_id, text, bytes, line_count``: a document as a file; the language decides the kind of file."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.expr(PATH).alias("path"), "doc_id", "text", F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\n")).alias("line_count"))


def lines(files: DataFrame) -> DataFrame:
    """``path, doc_id, line_no, line``, from 1; one carriage return at a line's end is dropped."""
    parts = files.select("path", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return parts.select("path", "doc_id", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("line"))


def changes(files: DataFrame) -> DataFrame:
    """``path, whole_file, start_line, end_line``: a change of lines 2 to 4 in some files, others new."""
    picked = files.where("doc_id % 17 = 0 or doc_id % 29 = 0")
    return picked.select("path", (F.col("doc_id") % 29 == 0).alias("whole_file"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
