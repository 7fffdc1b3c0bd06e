"""Queries over definitions, and the same in DuckDB SQL: every line of a document becomes a function of a class in its file's language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import extension
from tessera.operators import definitions
from tessera.plans.queries import FILES, LINES, query
from tessera.sources import carriers


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, doc_id, text``: code for ``.rs``, ``.py`` and ``.js``, where the line stands in a comment and every second has a decorator or note; prose as it is."""
    files = carriers.files(spark, sf_dir)
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    kind = extension(F.col("path"))

    def body(note: str, head: str, inner: str, end: str) -> Column:
        each = lambda x: F.concat(F.when(F.octet_length(x) % 2 == 0, note + "\n").otherwise(""), F.lit(head + "\n" + inner), x, F.lit(end))
        return F.array_join(F.transform(lines, each), "\n")

    rust = F.concat(F.lit("impl S {\n"), body("    #[inline]", "    fn line() {", "        // } ", "\n    }"), F.lit("\n}"))
    script = F.concat(F.lit("class C {\n"), body("  // note", "  line() {", "    // } ", "\n  }"), F.lit("\n}"))
    python = F.concat(F.lit("class C:\n"), body("    @dec", "    def line(self):", "        pass  # ", ""))
    return files.select("path", "doc_id", F.when(kind == "rs", rust).when(kind == "js", script).when(kind == "py", python).otherwise(F.col("text")).alias("text"))


_CODE = f"""{FILES}, {LINES},
shapes AS (SELECT path, line_no, CASE WHEN path LIKE '%.py' THEN 2 ELSE 3 END + CASE WHEN strlen(regexp_replace(line, '\\r$', '')) % 2 = 0 THEN 1 ELSE 0 END AS size FROM lines WHERE path NOT LIKE '%.md'),
functions AS (SELECT path, 2 + coalesce(sum(size) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line, 1 + sum(size) OVER (PARTITION BY path ORDER BY line_no) AS end_line FROM shapes),
classes AS (SELECT path, 1 AS start_line, max(end_line) + CASE WHEN path LIKE '%.py' THEN 0 ELSE 1 END AS end_line FROM functions GROUP BY path),
spans AS (SELECT * FROM functions UNION ALL SELECT * FROM classes)"""


@query(f"WITH {_CODE} SELECT path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM spans")
def definition_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.definitions(code_files(spark, sf_dir))


@query(
    f"""WITH {_CODE}, own AS (SELECT * FROM spans WHERE end_line - start_line < 48)
SELECT path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM own
UNION ALL SELECT path, CAST(min(line_no) AS INTEGER), CAST(max(line_no) AS INTEGER) FROM lines WHERE path NOT IN (SELECT path FROM own) GROUP BY path, (line_no - 1) // 48 HAVING bool_or(trim(line) <> '')"""
)
def definition_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return definitions.all_blocks(files, carriers.lines(files))


@query(
    f"""WITH {_CODE}, counted AS (SELECT path, unnest(range(1, CAST(end_line AS BIGINT) + 1)) AS line_no FROM classes UNION ALL SELECT path, line_no FROM lines WHERE path LIKE '%.md'),
found AS (SELECT c.path, c.line_no, coalesce(f.start_line, k.start_line) AS start_line, coalesce(f.end_line, k.end_line) AS end_line FROM counted c
  LEFT JOIN functions f ON f.path = c.path AND c.line_no BETWEEN f.start_line AND f.end_line LEFT JOIN classes k ON k.path = c.path AND k.end_line - k.start_line < 48)
SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM found"""
)
def enclosing_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the code is a hit."""
    files = code_files(spark, sf_dir)
    lines = carriers.lines(files)
    return definitions.enclosing_definition(files, lines, lines.select("path", "line_no"))


@query(
    f"""WITH {FILES}, {LINES}, spans AS (SELECT path, line_no AS start_line, line_no + strlen(line) % 60 AS end_line FROM lines WHERE strlen(line) % 60 < 48),
best AS (SELECT l.path, l.line_no, min(row(s.end_line - s.start_line, s.start_line, s.end_line)) AS b FROM lines l JOIN spans s ON s.path = l.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY ALL)
SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(b[2] AS INTEGER) AS start_line, CAST(b[3] AS INTEGER) AS end_line FROM lines LEFT JOIN best USING (path, line_no)"""
)
def tightest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a hit, and starts a span as long as its own length says."""
    lines = carriers.lines(carriers.files(spark, sf_dir))
    spans = lines.select("path", F.col("line_no").alias("start_line"), (F.col("line_no") + F.octet_length("line") % 60).cast("int").alias("end_line"))
    return definitions.tightest_span(lines, spans)
