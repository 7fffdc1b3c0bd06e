"""Queries over replies, ignore files, diffs, log lines and recall by meaning, made from the tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import replies
from tessera.plans.dense import Index, recalled, retrieved_by_meaning
from tessera.plans.queries import FILES, LINES, QUESTION, query
from tessera.plans.retrieve import Options
from tessera.sources import carriers, ignore
from tessera.sources.files import diff_hunks
from tessera.sources.tables import table
from tessera.streaming.metrics import parsed_lines

# ---------------------------------------------------------------- replies


def reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reply_id, conv_id, content``: every turn as a model's reply; what shape it has goes by role and length.

    A system's findings are null and its uncertainties one text; a user's finding is a single object; an assistant has
    two findings, one of an unknown path, or both where the length is a multiple of three; of multiples of seven the end is missing.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.char_length("text"))
    path = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))

    def found(path, last):
        return F.struct(path.alias("path"), F.lit(1).alias("startLine"), last.alias("endLine"), F.substring("text", 1, 40).alias("summary"))

    good, bad = found(path, F.col("turn") + 1), found(F.lit("elsewhere"), F.col("turn") + 1)
    system = F.to_json(F.struct(F.col("text").alias("answer"), F.lit(None).cast("string").alias("findings"), F.col("text").alias("uncertainties")), {"ignoreNullFields": "false"})
    user = F.to_json(F.struct(F.col("text").alias("answer"), good.alias("findings"), F.array("role", "text").alias("uncertainties"), F.lit(1).alias("more")))
    both = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.when(F.col("size") % 3 == 0, bad).otherwise(good), bad).alias("findings")))
    content = F.when(F.col("role") == "system", system).when(F.col("role") == "user", user).otherwise(both)
    cut = F.when(F.col("size") % 7 == 0, F.substring(content, F.lit(1), F.char_length(content) - 1)).otherwise(content)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), "conv_id", "turn", cut.alias("content"))


@query(
    """WITH t AS (SELECT *, conv_id * 1000 + turn AS reply_id, length(text) AS size, length(text) % 7 = 0 AS cut, role = 'assistant' AND length(text) % 3 = 0 AS lost FROM conversations)
SELECT reply_id, CASE WHEN cut THEN 'model returned invalid JSON' WHEN lost THEN 'all findings were dropped: unknown_path, unknown_path' END AS error,
  CASE WHEN NOT cut AND NOT lost THEN text END AS answer, CAST(CASE WHEN cut OR lost THEN NULL WHEN role = 'system' THEN 0 ELSE 1 END AS INTEGER) AS findings,
  CAST(CASE WHEN cut OR lost THEN NULL WHEN role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS dropped,
  CASE WHEN cut OR lost OR role = 'system' THEN NULL ELSE 'sed -n ''1,' || (turn + 1) || 'p'' conv_' || conv_id END AS hint,
  CASE WHEN cut OR lost THEN NULL WHEN role = 'system' THEN text WHEN role = 'user' THEN 'user|' || text ELSE '' END AS uncertainties FROM t"""
)
def grounded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each was shown is its conversation up to its own turn."""
    rows = reply_rows(spark, sf_dir)
    shown = rows.select("reply_id", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("path"), F.lit(1).alias("start_line"), (F.col("turn") + 1).cast("int").alias("end_line"))
    checked = replies.grounded_replies(rows.select("reply_id", "content"), shown)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return checked.select("reply_id", "error", "answer", count("findings").alias("findings"), count("dropped_findings").alias("dropped"), F.get("findings", F.lit(0))["verify_hint"].alias("hint"), F.array_join("uncertainties", "|").alias("uncertainties"))


@query(
    """SELECT conv_id * 1000 + turn AS reply_id, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE array_to_string([CAST(least(1.0, greatest(0.0, turn / 4.0)) AS DECIMAL(9, 2)), CAST(length(text) % 2 AS DECIMAL(9, 2))], '|') END AS scores,
  array_to_string(list_filter([role, 'Turn' || turn], lambda x: strlen(x) <= 64), '|') AS terms FROM conversations"""
)
def lenient_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, bare or under their name, one too few of every fifth; and terms, some twice."""
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.char_length("text"))
    items = F.array((F.col("turn") / 4.0).cast("double"), (F.col("size") % 2).cast("double"))
    items = F.when(F.col("size") % 5 == 0, F.slice(items, 1, 1)).otherwise(items)
    name = F.concat(F.lit("Turn"), F.col("turn").cast("string"))
    words = F.array("role", name, F.upper(name), F.lit("two words"))
    wrapped = lambda key, value: F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(value.alias(key)))).otherwise(F.to_json(value))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), wrapped("scores", items).alias("s"), wrapped("terms", words).alias("t"))
    scores = replies.score_replies(rows.select("reply_id", F.col("s").alias("content"), F.lit(2).alias("expected")))
    terms = replies.expansion_replies(rows.select("reply_id", F.col("t").alias("content")))
    told = F.concat_ws("|", F.get("scores", F.lit(0)).cast("decimal(9,2)"), F.get("scores", F.lit(1)).cast("decimal(9,2)"))
    return scores.join(terms, "reply_id").select("reply_id", F.when(F.col("scores").isNotNull(), told).alias("scores"), F.array_join("terms", "|").alias("terms"))


# ---------------------------------------------------------------- ignore files, diffs, log lines

_IGNORES = [("", "*.md\nsrc7/\n/src3/fr\n!doc_1*.md\n"), ("src1", "*.py\n!keep.py\n"), ("src1/en", "doc_?.rs\ndoc_1*\n!doc_12*\n"), ("src2", "es/\n"), ("src2/es", "!*.md\n"), ("src4", "**/doc_*5.*\n")]
_DEEP = "regexp_replace(path, '/', '/' || lang || '/')"


@query(
    f"""WITH {FILES}, p AS (SELECT path.split('/')[1] AS source, path.split('/')[2] AS name, lang, path.split('/')[1] || '/' || lang || '/' || path.split('/')[2] AS path FROM files JOIN documents USING (doc_id)),
d AS (SELECT path, CASE WHEN source = 'src7' OR source = 'src3' AND lang = 'fr' OR source = 'src2' AND lang = 'es' THEN TRUE
  WHEN source = 'src1' AND lang = 'en' AND regexp_matches(name, '^doc_12') THEN FALSE WHEN source = 'src1' AND lang = 'en' AND (regexp_matches(name, '^doc_1') OR regexp_matches(name, '^doc_.[.]rs$')) THEN TRUE
  WHEN source = 'src1' AND regexp_matches(name, '[.]py$') THEN TRUE WHEN source = 'src4' AND regexp_matches(name, '^doc_.*5[.]') THEN TRUE
  WHEN regexp_matches(name, '^doc_1.*[.]md$') THEN FALSE WHEN regexp_matches(name, '[.]md$') THEN TRUE ELSE FALSE END AS ignored FROM p)
SELECT path FROM d WHERE NOT ignored"""
)
def ignored_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore files in the root, in sources and in a source's languages, over all documents as files two folders deep."""
    docs = carriers.files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    files = docs.select(F.regexp_replace("path", F.lit("/"), F.concat(F.lit("/"), F.col("lang"), F.lit("/"))).alias("path"))
    held = spark.createDataFrame([(f"{folder}/.gitignore".lstrip("/"), text) for folder, text in _IGNORES], "path string, text string")
    return ignore.visible_files(files, ignore.ignore_rules(held))


@query(
    f"""WITH {FILES}, {LINES}, h AS (SELECT path AS file, doc_id AS diff_id, 2 * line_no AS start_line, 2 * line_no + strlen(line) % 3 - 1 AS end_line FROM lines WHERE strlen(line) % 3 > 0)
SELECT diff_id, file, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM h"""
)
def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff a document: a hunk a line, with none, one or two added lines that look like headers, and a removed one."""
    lines = carriers.lines(carriers.files(spark, sf_dir))
    count = F.octet_length("line") % 3
    head = F.when(count == 1, F.concat(F.lit("@@ -"), F.col("line_no").cast("string"), F.lit(" +"), (F.col("line_no") * 2).cast("string"), F.lit(" @@ "), "line"))
    head = head.otherwise(F.concat(F.lit("@@ -"), F.col("line_no").cast("string"), F.lit(",1 +"), (F.col("line_no") * 2).cast("string"), F.lit(","), count.cast("string"), F.lit(" @@")))
    body = F.concat(F.array(head, F.concat(F.lit("-"), "line")), F.array_repeat(F.lit("+++ b/not/a/header"), count))
    hunks = lines.select("doc_id", "path", F.col("line_no").alias("at"), F.posexplode(body).alias("k", "line"))
    top = carriers.files(spark, sf_dir).select("doc_id", "path", F.lit(0).alias("at"), F.posexplode(F.array(F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"))).alias("k", "line"))
    rows = top.unionByName(hunks).select(F.col("doc_id").alias("diff_id"), (F.col("at").cast("long") * 4 + F.col("k")).alias("line_no"), "line")
    return diff_hunks(rows)


@query(
    """WITH l AS (SELECT event_id % 11 = 0 AS broken, event_id % 13 = 0 AS unnamed, event_type, value, user_id FROM events)
SELECT event_type AS operation, count(*) AS runs, CAST(sum(user_id) AS BIGINT) AS total_tokens, 0 AS malformed FROM l WHERE NOT broken AND NOT unnamed GROUP BY event_type
UNION ALL SELECT NULL, 0, NULL, count(*) FROM l WHERE broken OR unnamed"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of the runs' log; of some the end is missing, others have no operation."""
    events = table(spark, sf_dir, "events")
    whole = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("operation"), F.lit(True).alias("success"), F.col("user_id").alias("total_tokens")))
    lines = events.select(F.when(F.col("event_id") % 11 == 0, F.substring(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole).alias("value"))
    rows = parsed_lines(lines).groupBy(F.when(F.col("malformed").isNull(), F.col("operation")).alias("operation"))
    good = F.col("malformed").isNull()
    return rows.agg(F.count_if(good).alias("runs"), F.sum(F.when(good, F.col("total_tokens"))).alias("total_tokens"), F.count("malformed").alias("malformed"))


# ---------------------------------------------------------------- recall by meaning

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each letter occurs."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


_COUNTS = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


@query(
    f"""WITH {FILES}, {LINES}, w AS (SELECT path, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY path, (line_no - 1) // 80 HAVING bool_or(trim(line) <> '')),
v AS (SELECT path, start_line, end_line, {_COUNTS} AS e FROM w), q AS (SELECT {_COUNTS} AS e FROM (SELECT '{QUESTION}' AS text)),
s AS (SELECT path, start_line, end_line, CASE WHEN list_sum(v.e) = 0 THEN 0 ELSE list_cosine_similarity(v.e, q.e) END AS similarity FROM v, q)
SELECT path, start_line, end_line, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, path, start_line LIMIT 24"""
)
def recalled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks nearest to the question, of all files; no bound on these."""
    near = recalled(carriers.files(spark, sf_dir), QUESTION, Index(letter_counts, max_files=None, max_blocks=None))
    return near.select("path", "start_line", "end_line", F.round("similarity", 6).alias("similarity"))


@query()
def retrieve_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieved_by_meaning(carriers.files(spark, sf_dir), QUESTION, Index(letter_counts, max_files=None, max_blocks=None), Options(budget_tokens=1200, max_hits=40))
    return found.chunks.drop("query_id")
