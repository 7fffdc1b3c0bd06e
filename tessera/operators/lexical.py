"""Lexical search: which lines hold which terms, what the terms weigh, and how hits and files rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import CLIFF_FILES, CLIFF_PERCENT, EXACT_NAME_FACTOR, HITS_PER_FILE, LINE_WEIGHT, MAX_FILES, MAX_HITS, NAME_FACTOR
from tessera.functions.terms import intrinsic_weights, query_terms, term_forms
from tessera.functions.text import coverage_weight, file_name, penalised, set_bits_sum, term_match, term_pattern


class Terms(NamedTuple):
    """A question's terms; there are a dozen at most, so they go into the plan as literals."""

    names: list[str]
    forms: list[list[str]]
    intrinsic: list[int]

    @classmethod
    def of(cls, question: str) -> Terms:
        names = query_terms(question)
        return cls(names, [term_forms(t) for t in names], intrinsic_weights(names))


def mask_of(flags: list[Column]) -> Column:
    out = F.lit(0)
    for i, flag in enumerate(flags):
        out = out + F.when(flag, 1 << i).otherwise(0)
    return out.cast("int")


def line_hits(lines: DataFrame, terms: Terms, per_file: int = HITS_PER_FILE) -> DataFrame:
    """``path, line_no, mask``: one cheap pattern of all forms picks the lines, then each term is told apart."""
    picked = lines.where(F.col("line").rlike(term_pattern([f for forms in terms.forms for f in forms])))
    hits = picked.select("path", "line_no", mask_of([term_match(F.col("line"), f) for f in terms.forms]).alias("mask"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return hits.withColumn("n", number).where(F.col("n") <= per_file).drop("n")


def file_coverage(hits: DataFrame) -> DataFrame:
    """``path, coverage``: which terms a file holds anywhere."""
    return hits.groupBy("path").agg(F.expr("bit_or(mask)").alias("coverage"))


def term_weights(coverage: DataFrame, terms: Terms) -> DataFrame:
    """One row ``weights``: rarer terms weigh more; the files are those with a hit."""
    held = [F.sum(F.getbit("coverage", F.lit(i)).cast("long")) for i in range(len(terms.names))]
    counted = coverage.agg(F.count(F.lit(1)).alias("n"), F.array(*held).alias("df"))
    weight = F.transform(
        F.arrays_zip("df", F.array(*[F.lit(w) for w in terms.intrinsic]).alias("intrinsic")),
        lambda x: F.greatest(F.lit(1), F.round(x["intrinsic"] * 4 * F.log2(1 + F.greatest("n", F.lit(1)) / F.greatest(x["df"], F.lit(1)))).cast("long")),
    )
    return counted.select("n", "df", weight.alias("weights"))


def directory_mask(path: Column, terms: Terms) -> Column:
    """Terms of which a form is part of any parent folder's name."""
    parts = F.split(F.lower(path), "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return mask_of([F.exists(parents, _holds(forms)) for forms in terms.forms])


def _holds(forms: list[str]) -> Callable[[Column], Column]:
    return lambda text: _any_contains(text, forms)


def _any_contains(text: Column, forms: list[str]) -> Column:
    out = F.lit(False)
    for form in forms:
        out = out | text.contains(form)
    return out


def filename_mask(path: Column, terms: Terms) -> Column:
    name = file_name(path)
    return mask_of([_any_contains(name, forms) for forms in terms.forms])


def exact_name_mask(path: Column, terms: Terms) -> Column:
    """Terms that are the file's name without its last extension."""
    bare = F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")
    return mask_of([bare.isin(forms) for forms in terms.forms])


def weight_array(weights: DataFrame) -> list[int]:
    """The weights on the driver: one row of a dozen numbers."""
    row = weights.first()
    return [int(w) for w in row["weights"]] if row and row["weights"] else []


def scored_hits(hits: DataFrame, coverage: DataFrame, weights: list[int], terms: Terms) -> DataFrame:
    """``path, line_no, mask, coverage, score`` before penalties."""
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    largest = lambda mask: F.array_max(F.transform(w, lambda x, i: F.when(F.getbit(mask, i) == 1, x).otherwise(F.lit(0).cast("long"))))
    boosted = coverage.select(
        "path",
        "coverage",
        (F.floor(coverage_weight(F.col("coverage"), w) / 2) + F.floor(set_bits_sum(directory_mask(F.col("path"), terms), w) * NAME_FACTOR / 2) + largest(exact_name_mask(F.col("path"), terms)) * EXACT_NAME_FACTOR).alias("file_part"),
    )
    return hits.join(boosted, "path").select("path", "line_no", "mask", "coverage", (set_bits_sum(F.col("mask"), w) * LINE_WEIGHT + F.col("file_part")).cast("long").alias("score"))


def filename_only_hits(files: DataFrame, coverage: DataFrame, weights: list[int], terms: Terms) -> DataFrame:
    """Files that only their name finds: line 1."""
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    named = files.select("path").distinct().withColumn("mask", filename_mask(F.col("path"), terms)).where("mask <> 0")
    alone = named.join(coverage, "path", "left_anti")
    return alone.select("path", F.lit(1).alias("line_no"), "mask", F.col("mask").alias("coverage"), (set_bits_sum(F.col("mask"), w) * NAME_FACTOR).alias("score"))


def search(files: DataFrame, lines: DataFrame, terms: Terms) -> DataFrame:
    """Every hit with its penalised score: ``path, line_no, mask, score``."""
    hits = line_hits(lines, terms)
    coverage = file_coverage(hits)
    weights = weight_array(term_weights(coverage, terms))
    if not weights:
        weights = [1] * len(terms.names)
    found = scored_hits(hits, coverage, weights, terms).unionByName(filename_only_hits(files, coverage, weights, terms))
    return found.select("path", "line_no", "mask", penalised(F.col("path"), F.col("score")).alias("score"))


def top_hits(hits: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    return hits.orderBy("score", "path", "line_no", ascending=[False, True, True]).limit(limit)


def diverse_hits(hits: DataFrame, limit: int = MAX_HITS) -> DataFrame:
    """Each file's best hit first, then all others."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line_no"))
    ranked = hits.withColumn("later", (place > 1).cast("int"))
    return ranked.orderBy("later", F.desc("score"), "path", "line_no").limit(limit).drop("later")


def overfull_spread(hits: DataFrame, limit: int = MAX_HITS, by: Sequence[str] = ("path",)) -> DataFrame:
    """A file (``by``) with more than ``limit`` hits keeps its strongest half of the limit, then hits spread evenly over its lines, then strong ones."""
    half = -(-limit // 2)
    spread = limit - half
    by_score = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "line_no"))
    by_line = F.row_number().over(Window.partitionBy(*by).orderBy("line_no", F.desc("score")))
    rows = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("rs", by_score).withColumn("rl", by_line)
    slots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(spread - 1, 0))), lambda s: (F.floor(s * (F.col("n") - 1) / max(spread - 1, 1)) if spread > 1 else F.col("n") - 1) + 1))
    in_slot = F.array_contains(slots, F.col("rl").cast("long")) if spread else F.lit(False)
    class_ = F.when(F.col("rs") <= half, 0).when(in_slot, 1).otherwise(2)
    kept = F.row_number().over(Window.partitionBy(*by).orderBy("class", F.when(F.col("class") == 1, F.col("rl")).otherwise(F.col("rs"))))
    rows = rows.withColumn("class", class_).withColumn("place", kept)
    return rows.where((F.col("n") <= limit) | (F.col("place") <= limit)).select(hits.columns)


def file_ranking(hits: DataFrame) -> DataFrame:
    """``path, score``: a file's best hit."""
    return hits.groupBy("path").agg(F.max("score").alias("score"))


def concentration_cliff(ranked: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The files before the first drop of more than a share of the top score, three at least; ``max_files`` at most."""
    head = ranked.orderBy(F.desc("score"), "path").limit(max_files + 1)
    order = Window.orderBy(F.desc("score"), "path")  # over max_files + 1 rows
    rows = head.withColumn("rn", F.row_number().over(order)).withColumn("before", F.lag("score").over(order)).withColumn("top", F.first("score").over(order))
    drop = (F.col("before") - F.col("score")) * 100 > F.col("top") * CLIFF_PERCENT
    rows = rows.withColumn("cut", F.min(F.when((F.col("top") > 0) & drop, F.col("rn") - 1)).over(Window.partitionBy(F.lit(0))))
    return rows.where((F.col("rn") <= F.greatest(F.coalesce("cut", F.lit(max_files)), F.lit(CLIFF_FILES))) & (F.col("rn") <= max_files)).select("path", "score", "rn")
