"""Queries over a table of questions, and the same in DuckDB SQL: the sentences of the benchmark's passages are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import MAX_FILES, MAX_HITS, STOP_WORDS
from tessera.operators import batch, corpus
from tessera.plans.batch import batch_ranked, evaluate_batch, retrieve_batch
from tessera.plans.queries import _METADATA, _PROSE, FILES, LINES, query
from tessera.plans.retrieve import Options
from tessera.sources import carriers
from tessera.sources.tables import table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, question``: every sentence of every passage."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]+")).alias("i", "part"))
    return parts.select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), F.trim("part").alias("question")).where("question <> ''")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, path, start_line, end_line``: the lines that hold the sentence as one of their own."""
    lines = carriers.lines(carriers.files(spark, sf_dir))
    own = lines.select("path", "line_no", F.explode(F.split("line", r"\.+")).alias("part")).select("path", "line_no", F.trim("part").alias("question"))
    met = own.join(questions(spark, sf_dir), "question").select("query_id", "path", "line_no").distinct()
    return met.select("query_id", "path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))


def _stem(x: str) -> str:
    low = f"lower({x})"
    return f"(CASE WHEN ends_with({low}, 'tted') AND strlen({low}) > 6 THEN {low}[:-4] WHEN (ends_with({low}, 'ed') AND strlen({low}) > 5) OR (ends_with({low}, 'es') AND strlen({low}) > 4) THEN {low}[:-3] WHEN ends_with({low}, 's') AND strlen({low}) > 3 AND NOT regexp_matches({low}, '(ss|us|is)$') THEN {low}[:-2] ELSE {low} END)"


_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_SPACED = "regexp_replace(regexp_replace(regexp_replace(term, '[_\\-.:/]+', ' ', 'g'), '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g')"
_QUESTIONS = """parts AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS part, unnest(range(len(regexp_split_to_array(text, '[.\\n]+')))) AS i FROM benchmark),
questions AS (SELECT item_id * 1000 + i AS query_id, trim(part, ' ') AS question FROM parts WHERE trim(part, ' ') <> '')"""
_TERMS = f"""{_QUESTIONS},
found AS (SELECT query_id, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_:.\\-/]+') AS tokens FROM questions),
tokens AS (SELECT query_id, i, regexp_replace(token, '^[.:/\\-]+|[.:/\\-]+$', '', 'g') AS term FROM (SELECT query_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM found)),
stems AS MATERIALIZED (SELECT *, {_stem('term')} AS stem FROM tokens WHERE (length(term) >= 3 OR length(term) = 2 AND regexp_matches(term, '^[A-Z]{{2}}$|[0-9]')) AND lower(term) NOT IN ({_STOPS})),
firsts AS MATERIALIZED (SELECT * FROM stems QUALIFY row_number() OVER (PARTITION BY query_id, stem ORDER BY i) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS n, list_filter(regexp_split_to_array(trim({_SPACED}), ' +'), lambda x: x <> '') AS words FROM firsts),
terms AS MATERIALIZED (SELECT query_id, n, term, list_sort(list_distinct([stem] || CASE WHEN len(words) > 1 THEN [{_stem("array_to_string(words, '_')")}, {_stem("array_to_string(words, '-')")}, {_stem("array_to_string(words, '')")}] ELSE [] END)) AS forms,
  CASE WHEN regexp_matches(term, '(?s)_|::|\\.|^.+[A-Z]') THEN 3 WHEN strlen(term) >= 8 THEN 2 ELSE 1 END + CASE WHEN n = 0 THEN 1 ELSE 0 END AS intrinsic FROM numbered WHERE n < 12)"""
_HITS = f"""{FILES}, {LINES}, {_TERMS},
forms AS (SELECT query_id, n, unnest(forms) AS form FROM terms),
tok AS (SELECT path, line_no, unnest(list_distinct(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_:.\\-/]+'))) AS token FROM lines),
tails AS (SELECT token, token[i:] AS tail FROM (SELECT token, unnest(list_filter(range(1, length(token) + 1), lambda i: i = 1 OR NOT regexp_matches(token[i - 1], '[\\p{{L}}\\p{{N}}]'))) AS i FROM (SELECT DISTINCT token FROM tok))),
matched AS (SELECT DISTINCT query_id, n, token FROM forms JOIN tails ON starts_with(tail, form)),
bits AS (SELECT DISTINCT query_id, path, line_no, n FROM matched JOIN tok USING (token)),
hits AS (SELECT query_id, path, line_no, sum(1 << n) AS mask FROM bits GROUP BY ALL),
cov AS (SELECT DISTINCT query_id, path, n FROM bits),
df AS (SELECT query_id, n, count(*) AS df FROM cov GROUP BY ALL), held AS (SELECT query_id, count(DISTINCT path) AS files FROM cov GROUP BY ALL),
w AS (SELECT query_id, n, greatest(1, CAST(round(intrinsic * 4 * log2(1 + greatest(coalesce(files, 0), 1) / greatest(coalesce(df, 0), 1))) AS BIGINT)) AS w FROM terms LEFT JOIN df USING (query_id, n) LEFT JOIN held USING (query_id))"""
_NAME = "lower(regexp_extract(path, '[^/]*$'))"
_SEARCH = f"""{_HITS},
known AS (SELECT query_id, path, max(w) + (sum(w) - max(w)) // 3 AS cw FROM cov JOIN w USING (query_id, n) GROUP BY ALL),
near AS (SELECT query_id, path, n, bool_or(contains(lower(regexp_replace(path, '[^/]*$', '')), form)) AS folder, bool_or(regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1') = form) AS exact FROM known JOIN forms USING (query_id) GROUP BY ALL),
boosts AS (SELECT query_id, path, coalesce(sum(w) FILTER (folder), 0) * 2 // 2 + coalesce(max(w) FILTER (exact), 0) * 8 AS boost FROM near JOIN w USING (query_id, n) GROUP BY ALL),
lined AS (SELECT query_id, path, line_no, sum(w) * 4 AS own FROM bits JOIN w USING (query_id, n) GROUP BY ALL),
named AS (SELECT DISTINCT query_id, path, n FROM files JOIN forms ON contains({_NAME}, form)),
plain AS (SELECT query_id, path, line_no, mask, own + cw // 2 + boost AS score FROM hits JOIN lined USING (query_id, path, line_no) JOIN known USING (query_id, path) JOIN boosts USING (query_id, path)
  UNION ALL SELECT query_id, path, 1, sum(1 << n), sum(w) * 2 FROM named JOIN w USING (query_id, n) ANTI JOIN known USING (query_id, path) GROUP BY ALL),
ranked AS (SELECT query_id, path, CAST(line_no AS INTEGER) AS line_no, CAST(mask AS INTEGER) AS mask, CAST(CASE WHEN score <= 0 THEN score WHEN {_PROSE} THEN greatest(1, score // 3) WHEN {_METADATA} THEN greatest(1, score // 2) ELSE score END AS BIGINT) AS score FROM plain),
best AS (SELECT query_id, path, max(score) AS score FROM ranked GROUP BY ALL),
places AS (SELECT *, row_number() OVER o AS rn, lag(score) OVER o AS before, first_value(score) OVER o AS top FROM best WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, path)),
cliff AS (SELECT *, min(CASE WHEN top > 0 AND rn <= 31 AND (before - score) * 100 > top * 30 THEN rn - 1 END) OVER (PARTITION BY query_id) AS cut FROM places),
leaders AS (SELECT query_id, path, score, CAST(rn AS INTEGER) AS rn FROM cliff WHERE rn <= greatest(coalesce(cut, 30), 3) AND rn <= 30)"""
#: The same with all terms of a question; a mask is their numbers, as no integer holds any number of bits.
_SEARCH_ALL = _SEARCH.replace(" WHERE n < 12", "").replace("sum(1 << n)", "string_agg(n, ',' ORDER BY n)").replace("CAST(mask AS INTEGER) AS mask", "mask")
_EXPECTED = "wanted AS (SELECT DISTINCT query_id, path, line_no FROM (SELECT path, line_no, trim(unnest(regexp_split_to_array(line, '\\.+')), ' ') AS question FROM lines) JOIN questions USING (question))"


@query(f"WITH {_TERMS} SELECT query_id, CAST(n AS INTEGER) AS n, term, array_to_string(forms, '|') AS forms, CAST(intrinsic AS INTEGER) AS intrinsic FROM terms")
def batch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.question_terms(questions(spark, sf_dir)).withColumn("forms", F.array_join(F.array_sort("forms"), "|"))


@query(f"WITH {_HITS} SELECT query_id, path, CAST(line_no AS INTEGER) AS line_no, CAST(mask AS INTEGER) AS mask FROM hits")
def batch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_hits(carriers.files(spark, sf_dir), batch.question_terms(questions(spark, sf_dir)), per_file=None)


@query(f"WITH {_SEARCH_ALL} SELECT query_id, path, line_no, mask, score FROM ranked")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_search(carriers.files(spark, sf_dir), batch.question_terms(questions(spark, sf_dir), most=None), per_file=None, text=True)


@query(f"WITH {_SEARCH} SELECT query_id, path, score, rn FROM leaders")
def batch_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_cliff(corpus.corpus_search(carriers.files(spark, sf_dir), batch.question_terms(questions(spark, sf_dir)), MAX_FILES + 1, per_file=None))


@query(
    f"""WITH {_SEARCH}, {_EXPECTED},
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, line_no) > 1 AS later FROM ranked),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, score DESC, path, line_no) AS position FROM placed),
ranks AS (SELECT query_id, min(position) FILTER (position <= 200) AS rank FROM (SELECT DISTINCT query_id, path, line_no FROM wanted) LEFT JOIN ordered USING (query_id, path, line_no) GROUP BY query_id),
k AS (SELECT unnest([1, 3, 5]) AS k)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count(*) AS cases FROM ranks, k GROUP BY k"""
)
def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a line that holds the sentence is among the first hits, over all sentences that some line holds."""
    hits = corpus.corpus_search(carriers.files(spark, sf_dir), batch.question_terms(questions(spark, sf_dir)), MAX_HITS, per_file=None)
    results = batch.batch_top(hits).withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no"))
    report = evaluate_batch(results, expected(spark, sf_dir))
    return report.hit_at_k.crossJoin(report.mrr)  # one row


@query()
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered chunks of every sentence."""
    return retrieve_batch(carriers.files(spark, sf_dir), questions(spark, sf_dir), Options(budget_tokens=1200, max_hits=40)).drop("mask")


@query()
def batch_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_ranked(carriers.files(spark, sf_dir), questions(spark, sf_dir), Options(max_hits=40))
