"""Queries over shapes of lines, chunks and what a retrieval returns, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import assembly, chunks, evaluation, lexical
from tessera.plans.queries import _PLAIN, _SQL_TOKENS, FILES, LINES, TERMS, _sql_hits, _sql_search, query
from tessera.sources import carriers

_MARKED = "marked AS (SELECT path, line_no, CASE WHEN strlen(line) % 5 = 0 THEN '' WHEN strlen(line) % 5 = 1 THEN '  // ' || line WHEN strlen(line) % 5 = 2 THEN '    )' || line WHEN strlen(line) % 5 = 3 THEN ' {' ELSE '});' END AS line FROM lines)"


def marked_lines(lines: DataFrame) -> DataFrame:
    """Lines as code has them, by their lengths: blank, comments, ends of signatures, brackets alone."""
    size = F.octet_length("line") % 5
    line = F.when(size == 0, "").when(size == 1, F.concat(F.lit("  // "), "line")).when(size == 2, F.concat(F.lit("    )"), "line")).when(size == 3, " {").otherwise("});")
    return lines.withColumn("line", line)


@query(
    f"""WITH {FILES}, {LINES}, {_MARKED}
SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(CASE WHEN trim(line) <> '' THEN strlen(line) - strlen(ltrim(line)) END AS INTEGER) AS indent,
  regexp_matches(line, '^\\s*[)\\]}}]') OR regexp_matches(line, '^[{{(\\[ \\t]+$') AS continuation, starts_with(ltrim(line), '//') AS annotation, regexp_matches(line, '^\\s*[(){{}}\\[\\];,]*\\s*$') AS trivial,
  CAST(length(line) + len(regexp_extract_all(line, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT) AS units FROM marked"""
)
def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_lines(carriers.lines(carriers.files(spark, sf_dir)))
    line = F.col("line")
    return rows.select("path", "line_no", T.line_indent(line).cast("int").alias("indent"), T.is_continuation(line).alias("continuation"), T.is_annotation(line).alias("annotation"), T.is_trivial(line).alias("trivial"), T.utf16_length(line).cast("long").alias("units"))


@query(f"WITH {FILES}, {LINES} SELECT path, string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no) AS numbered FROM lines WHERE line_no >= 2 GROUP BY path")
def numbered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the second line to the last."""
    files = carriers.files(spark, sf_dir).where("line_count > 1")
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return files.select("path", T.numbered_range(lines, F.lit(2), F.col("line_count")).alias("numbered"))


@query(f"WITH {FILES}, {LINES}, {_sql_hits(TERMS)} SELECT path, CAST(line_no AS INTEGER) AS line_no, array_to_string([{', '.join(f'''CASE WHEN (mask >> {i}) & 1 = 1 THEN '{t}' END''' for i, t in enumerate(TERMS.names))}], '|') AS terms FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 2")
def capped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two hits of each file, with the names of their terms."""
    hits = lexical.line_hits(carriers.lines(carriers.files(spark, sf_dir)), TERMS, per_file=2)
    return hits.select("path", "line_no", F.array_join(T.decode_terms(F.col("mask"), TERMS.names), "|").alias("terms"))


# Without context and with a budget that no two lines share, every hit is a chunk of its own line.


def _sql_chunks(hits: str) -> str:
    return f"""best AS (SELECT path, max(score) AS file_score FROM {hits} GROUP BY path),
chunk AS (SELECT f.path, CAST(f.line_no AS INTEGER) AS start_line, CAST(f.line_no AS INTEGER) AS end_line, CAST(f.score * (10 + least(greatest(bit_count(CAST(f.mask AS INTEGER)) - 1, 0), 3)) + file_score // 4 AS BIGINT) AS score,
  (f.line_no || ': ' || line) AS content, CAST(f.mask AS INTEGER) AS mask FROM {hits} f JOIN best USING (path) JOIN lines l ON l.path = f.path AND l.line_no = f.line_no),
chunks AS (SELECT *, CAST({_SQL_TOKENS.format('content')} + {_SQL_TOKENS.format('path')} + 40 AS BIGINT) AS estimated_tokens FROM chunk)"""


def hit_chunks(files: DataFrame, hits: DataFrame) -> DataFrame:
    ranked = lexical.file_ranking(hits).withColumn("query_id", F.lit(0).cast("long"))
    return chunks.chunk_candidates(hits.withColumn("query_id", F.lit(0).cast("long")), ranked, files, budget=1, context=0)


def found_in(files: DataFrame) -> DataFrame:
    return lexical.search(files, carriers.lines(files), TERMS)


@query(f"WITH {_sql_search(TERMS)}, {_sql_chunks('found')} SELECT 0::BIGINT AS query_id, path, start_line, end_line, score, estimated_tokens, content, mask FROM chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = carriers.files(spark, sf_dir)
    return hit_chunks(files, found_in(files))


# Of the top hits; relevance alone, and room for all that passes the floor: the order is that of scores, six chunks of a file.
_PACKED = f"""{_sql_search(TERMS)}, top AS (SELECT path, line_no, mask, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line_no) > 1 AS later FROM found) ORDER BY later, score DESC, path, line_no LIMIT 200),
{_sql_chunks('top')}, floored AS (SELECT * FROM chunks WHERE score * 100 >= (SELECT max(score) FROM chunks) * 15),
places AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line) AS place FROM floored),
packed AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path, start_line) AS INTEGER) AS position FROM places WHERE place <= 6)"""


def top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the top hits, two hundred as in every retrieval."""
    files = carriers.files(spark, sf_dir)
    return hit_chunks(files, lexical.diverse_hits(found_in(files)))


def packed_rows(found: DataFrame) -> DataFrame:
    return chunks.mmr_pack(chunks.relevance_floor(found), 10**9, 1.0)


@query(f"WITH {_PACKED} SELECT 0::BIGINT AS query_id, path, start_line, end_line, score, estimated_tokens, content, mask, position FROM packed")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(top_chunks(spark, sf_dir))


@query(
    f"""WITH {_PACKED} SELECT 0::BIGINT AS query_id, 1 AS version, '{'|'.join(TERMS.names)}' AS terms, (SELECT count(*) FROM packed) AS chunks, CAST((SELECT sum(estimated_tokens) FROM packed) AS BIGINT) AS estimated_tokens,
  (SELECT count(*) FROM packed) < (SELECT count(*) FROM chunks) AS truncated, CAST((SELECT sum(strlen(text)) FROM documents) AS BIGINT) AS baseline_bytes"""
)
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_chunks(spark, sf_dir)
    rows = assembly.result_summary(packed_rows(found), found, carriers.files(spark, sf_dir), TERMS.names)
    return rows.withColumn("terms", F.array_join("query_terms", "|")).drop("query_terms")


@query(
    f"""WITH {_PACKED} SELECT 0::BIGINT AS query_id, path, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(any_value(line_count) AS INTEGER) AS line_count, string_agg(content, chr(10) ORDER BY position) AS numbered_content,
  string_agg(start_line || '-' || end_line, ',' ORDER BY position) AS ranges FROM packed JOIN (SELECT path, count(*) AS line_count FROM lines GROUP BY path) USING (path) GROUP BY path"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembly.evidence_documents(packed_rows(top_chunks(spark, sf_dir)), carriers.files(spark, sf_dir))
    told = F.array_join(F.transform("allowed_ranges", lambda r: F.concat(r["start_line"].cast("string"), F.lit("-"), r["end_line"].cast("string"))), ",")
    return rows.withColumn("ranges", told).drop("allowed_ranges")


@query(
    f"""WITH {FILES}, {LINES}, {_PLAIN}, c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM plain WHERE mask <> 0),
f AS (SELECT path, bit_count(CAST(bit_or(mask) AS INTEGER)) AS terms, count(*) AS lines FROM c WHERE n <= 20 GROUP BY path)
SELECT path, CAST(terms AS INTEGER) AS terms, lines, CAST(row_number() OVER (ORDER BY terms DESC, lines DESC, path) AS INTEGER) AS file_rank FROM f QUALIFY file_rank <= 200"""
)
def plain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.plain_order(evaluation.plain_search_ranking(carriers.lines(carriers.files(spark, sf_dir)), TERMS.names))
