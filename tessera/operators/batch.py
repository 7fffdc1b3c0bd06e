"""Many questions at once: their terms are a table, matched with the corpus by joins, so that one scan serves all.

Lines become a posting table of distinct tokens; the vocabulary meets the questions' spellings by equal prefixes of
the lengths that occur among these, and the tokens found lead to the lines. Everything that one question has as
literals in its plan (spellings, weights) is a column here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import CLIFF_FILES, CLIFF_PERCENT, EXACT_NAME_FACTOR, HITS_PER_FILE, LINE_WEIGHT, MAX_FILES, MAX_HITS, MAX_TERMS, NAME_FACTOR, STOP_WORDS
from tessera.functions.text import coverage_weight, file_name, intrinsic_weight, penalised, set_bits_sum, split_words, stem

#: What a term may hold; and a token of a line, as a capital I with a dot is lower case with a mark.
TERM, TOKEN = r"[\p{L}\p{N}_:.\-/]+", r"[\p{L}\p{N}_:.\-/\u0307]+"
#: Letters that ignoring case makes equal beyond their lower case.
FOLDED, FOLDS = "ςſµ", "σsμ"


def folded(text: Column) -> Column:
    """Lower case as matching without regard to case has it."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), FOLDED, FOLDS)


def term_forms(term: Column) -> Column:
    """The spellings that count as the term: its stem, and of a compound its words joined in three ways."""
    words = split_words(term)
    joined = F.array(*[stem(F.array_join(words, j)) for j in ("_", "-", "")])
    return F.array_distinct(F.concat(F.array(stem(term)), F.when(F.size(words) > 1, joined).otherwise(F.array().cast("array<string>"))))


def question_terms(questions: DataFrame, most: int | None = MAX_TERMS) -> DataFrame:
    """``query_id, n, term, forms, intrinsic``: the searchable terms of each question in order, one for each stem, the first ``most`` or all.

    ``questions`` has ``query_id, question``. A null question, or one without searchable terms, has no rows.
    """
    found = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(TERM), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^[.:/\-]+|[.:/\-]+$", ""))
    stops = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    short = lambda t: (F.char_length(t) == 2) & t.rlike("^[A-Z]{2}$|[0-9]")
    kept = questions.select("query_id", F.filter(bare, lambda t: ((F.char_length(t) >= 3) | short(t)) & ~F.array_contains(stops, F.lower(t))).alias("kept"))
    kept = kept.withColumn("stems", F.transform("kept", stem))
    first = F.filter("kept", lambda t, i: F.array_position(F.col("stems"), stem(t)) == i + 1)
    rows = kept.select("query_id", F.posexplode(first if most is None else F.slice(first, 1, most)).alias("n", "term"))
    return rows.select("query_id", "n", "term", F.transform(term_forms(F.col("term")), folded).alias("forms"), intrinsic_weight(F.col("term"), F.col("n") == 0).alias("intrinsic"))


def postings(lines: DataFrame) -> DataFrame:
    """``token, path, line_no``: each distinct token of a line, case folded. Write it once to serve many batches."""
    tokens = F.array_distinct(F.regexp_extract_all(folded(F.col("line")), F.lit(TOKEN), F.lit(0)))
    return lines.select(F.explode(tokens).alias("token"), "path", "line_no")


def _lengths(terms: DataFrame) -> list[int]:
    """The distinct lengths of all spellings: some dozen numbers, as a question is bounded."""
    rows = terms.select(F.explode("forms").alias("form")).select(F.char_length("form").alias("size")).distinct().collect()
    return sorted(r["size"] for r in rows if r["size"])


def _pieces(text: Column, starts: Column, lengths: list[int]) -> Column:
    """The distinct parts of ``text`` that begin at ``starts`` and have one of the lengths."""
    sizes = F.array(*[F.lit(n) for n in lengths])
    at = lambda i: F.transform(F.filter(sizes, lambda n: n <= F.char_length(text) - i + 1), lambda n: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(starts, at)))


def term_tokens(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """``query_id, n, token``: the tokens that hold a spelling of a term, at their start or behind no letter or digit.

    A token is looked up by its parts of the lengths that spellings have, so only equal strings ever meet.
    """
    lengths = _lengths(terms)
    if not lengths:
        return terms.select("query_id", "n", F.lit("").alias("token")).limit(0)
    token = F.col("token")
    starts = F.filter(F.sequence(F.lit(1), F.char_length(token)), lambda i: (i == 1) | F.substring(token, i - 1, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    parts = tokens.select("token").distinct().select("token", F.explode(_pieces(token, starts, lengths)).alias("form"))
    forms = terms.select("query_id", "n", F.explode("forms").alias("form"))
    return forms.join(parts, "form").select("query_id", "n", "token").distinct()


def batch_hits(terms: DataFrame, posted: DataFrame, per_file: int = HITS_PER_FILE) -> DataFrame:
    """``query_id, path, line_no, mask``: the lines that hold terms of a question, the first ``per_file`` of each file.

    The tokens found are kept, so that Spark knows their size before it decides how to join them with the postings:
    few go to the postings, many are dealt out by token, where hot ones are split at run time.
    """
    found = term_tokens(terms, posted).persist()
    found.count()
    rows = posted.join(found, "token").groupBy("query_id", "path", "line_no").agg(F.expr("bit_or(shiftleft(1, n))").alias("mask"))
    number = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("line_no"))
    return rows.withColumn("place", number).where(F.col("place") <= per_file).drop("place")


def batch_weights(terms: DataFrame, coverage: DataFrame) -> DataFrame:
    """``query_id, weights, forms``: what each question's terms weigh, from the files (``query_id, path, coverage``) that hold them."""
    held = F.array(*[F.sum(F.getbit("coverage", F.lit(i)).cast("long")) for i in range(MAX_TERMS)])
    return weights_of(terms, coverage.groupBy("query_id").agg(F.count(F.lit(1)).alias("files"), held.alias("df")))


def weights_of(terms: DataFrame, counted: DataFrame) -> DataFrame:
    """As :func:`batch_weights`, from the counts (``query_id, files, df``)."""
    own = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "intrinsic", "forms"))).alias("t"))
    files = F.greatest(F.coalesce("files", F.lit(0)), F.lit(1))
    weight = lambda t: F.greatest(F.lit(1), F.round(t["intrinsic"] * 4 * F.log2(1 + files / F.greatest(F.coalesce(F.get("df", t["n"]), F.lit(0)), F.lit(1)))).cast("long"))
    rows = own.join(counted, "query_id", "left")
    return rows.select("query_id", F.transform("t", weight).alias("weights"), F.transform("t", lambda t: t["forms"]).alias("forms"))


def _mask(forms: Column, holds) -> Column:
    bits = F.transform(forms, lambda fs, i: F.when(F.exists(fs, holds), F.pow(F.lit(2), i)).otherwise(0).cast("int"))
    return F.aggregate(bits, F.lit(0), lambda s, b: s + b)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row: the optimizer would move them into lambdas, which run for every element."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def batch_search(files: DataFrame, lines: DataFrame, terms: DataFrame, posted: DataFrame | None = None, hits_per_file: int = HITS_PER_FILE) -> DataFrame:
    """``query_id, path, line_no, mask, score``: every hit of every question, penalised, files that only their name finds too.

    ``files`` (``path``), ``lines`` (``path, line_no, line``) or their ``posted`` table, ``terms`` of :func:`question_terms`.
    Gives what a search for each question alone gives. The lines' hits are kept (in memory, else on disk) for weights and scores.
    """
    hits = batch_hits(terms, postings(lines) if posted is None else posted, hits_per_file).persist()
    coverage = hits.groupBy("query_id", "path").agg(F.expr("bit_or(mask)").alias("coverage"))
    weights = batch_weights(terms, coverage)
    w, path = F.col("weights"), F.col("path")
    placed = once(coverage.join(weights, "query_id"), parents=F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1), bare=F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1"))
    placed = once(placed, folder=_mask(F.col("forms"), lambda f: F.exists("parents", lambda p: p.contains(f))), exact=_mask(F.col("forms"), lambda f: F.col("bare") == f))
    largest = F.array_max(F.transform(w, lambda x, i: F.when(F.getbit("exact", i) == 1, x).otherwise(F.lit(0).cast("long"))))
    part = F.floor(coverage_weight(F.col("coverage"), w) / 2) + F.floor(set_bits_sum(F.col("folder"), w) * NAME_FACTOR / 2) + largest * EXACT_NAME_FACTOR
    parts = placed.select("query_id", "path", "weights", part.alias("file_part"))
    score = (set_bits_sum(F.col("mask"), w) * LINE_WEIGHT + F.col("file_part")).cast("long")
    scored = hits.join(parts, ["query_id", "path"]).select("query_id", "path", "line_no", "mask", score.alias("score"))
    named = filename_masks(files, terms).join(coverage, ["query_id", "path"], "left_anti").join(weights, "query_id")
    alone = named.select("query_id", "path", F.lit(1).alias("line_no"), "mask", (set_bits_sum(F.col("mask"), w) * NAME_FACTOR).alias("score"))
    found = scored.unionByName(alone)
    return found.withColumn("score", penalised(F.col("path"), F.col("score")))


def filename_masks(files: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, path, mask``: which terms a file's name holds anywhere, by equal parts of the name."""
    lengths = _lengths(terms)
    named = files.select("path", file_name(F.col("path")).alias("name")).distinct()
    if not lengths:
        return named.select(F.lit(0).cast("long").alias("query_id"), "path", F.lit(0).alias("mask")).limit(0)
    name = F.col("name")
    parts = named.select("name").distinct().where("name <> ''").select("name", F.explode(_pieces(name, F.sequence(F.lit(1), F.char_length(name)), lengths)).alias("form"))
    forms = terms.select("query_id", "n", F.explode("forms").alias("form"))
    masks = forms.join(parts, "form").groupBy("query_id", "name").agg(F.expr("bit_or(shiftleft(1, n))").alias("mask"))
    return masks.join(named, "name").select("query_id", "path", "mask")


def batch_top(hits: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """Each question's hits in order of rank: of every file the best one first, then all others."""
    place = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "line_no"))
    ranked = hits.withColumn("later", (place > 1).cast("int"))
    order = Window.partitionBy("query_id").orderBy("later", F.desc("score"), "path", "line_no")
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("later")


def batch_cliff(hits: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """``query_id, path, score, rn``: each question's files before the first steep drop of their best scores."""
    files = hits.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    head = files.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_files + 1)
    rows = head.withColumn("before", F.lag("score").over(order)).withColumn("top", F.first("score").over(order))
    drop = (F.col("before") - F.col("score")) * 100 > F.col("top") * CLIFF_PERCENT
    rows = rows.withColumn("cut", F.min(F.when((F.col("top") > 0) & drop, F.col("rn") - 1)).over(Window.partitionBy("query_id")))
    return rows.where((F.col("rn") <= F.greatest(F.coalesce("cut", F.lit(max_files)), F.lit(CLIFF_FILES))) & (F.col("rn") <= max_files)).select("query_id", "path", "score", "rn")
