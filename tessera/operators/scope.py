"""Search within a change: hits in changed files, boosts for changed lines and new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import SCOPE_FACTOR, UNTRACKED_FACTOR


def scope_hits(hits: DataFrame, changes: DataFrame) -> DataFrame:
    """Hits in changed files only; those on changed lines, or in files new as a whole, count three times.

    ``changes`` has a row for each hunk: ``path, whole_file, start_line, end_line``.
    """
    hunks = changes.groupBy("path").agg(F.max("whole_file").alias("whole_file"), F.collect_list(F.struct("start_line", "end_line")).alias("hunks"))
    inside = F.col("whole_file") | F.exists("hunks", lambda h: F.col("line_no").between(h["start_line"], h["end_line"]))
    return hits.join(hunks, "path").select("path", "line_no", "mask", F.when(inside, F.col("score") * SCOPE_FACTOR).otherwise(F.col("score")).alias("score"))


def untracked_boost(hits: DataFrame, untracked: DataFrame) -> DataFrame:
    """Hits in files that no commit has yet count twice."""
    fresh = untracked.select("path").distinct().withColumn("fresh", F.lit(True))
    return hits.join(fresh, "path", "left").select("path", "line_no", "mask", F.when(F.coalesce("fresh", F.lit(False)), F.col("score") * UNTRACKED_FACTOR).otherwise(F.col("score")).alias("score"))
