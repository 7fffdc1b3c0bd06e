"""The whole retrieval: search, rank, cut, expand, floor, pack."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import BLOCK_LINES, BUDGET_TOKENS, CONTEXT_LINES, DIFF_TEXT, ENVELOPE_TOKENS, FLOOR_PERCENT, MAX_HITS, MMR_LAMBDA, QUESTION_BYTES, REQUEST_BYTES
from tessera.functions.text import estimate_tokens, is_binary, numbered_range
from tessera.operators import assembly, chunks, definitions, dense, dense_index, feedback, lexical, scope, structure
from tessera.sources.carriers import lines as lines_of
from tessera.sources.files import glob_filter


@dataclass(frozen=True)
class Options:
    """What a question may set; the defaults are the engine's."""

    budget_tokens: int = BUDGET_TOKENS
    context_lines: int = CONTEXT_LINES
    max_hits: int = MAX_HITS
    mmr_lambda: float = MMR_LAMBDA
    max_block_lines: int = BLOCK_LINES
    min_score_percent: int = FLOOR_PERCENT
    globs: tuple[str, ...] = field(default=())
    prf: bool = False
    why: bool = False
    #: Blocks by definition (functions, classes) where the language is known, else by indent; or by indent alone.
    by_definition: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.budget_tokens <= -(-REQUEST_BYTES // 4) or not 1 <= self.max_hits <= 5000 or self.context_lines > 500:
            raise ValueError("budget, hits or context lines out of bounds")


@dataclass(frozen=True)
class Change:
    """A change to search in: ``ranges`` (``path, whole_file, start_line, end_line``), their paths and the changed text."""

    ranges: DataFrame
    paths: tuple[str, ...] = ()
    text: str = ""


class Retrieved(NamedTuple):
    """What a question brings: delivered chunks, one row of totals, and the evidence by file."""

    chunks: DataFrame
    summary: DataFrame
    documents: DataFrame


def bounded(rows: DataFrame) -> DataFrame:
    """A few rows (``max_hits`` or ``MAX_FILES`` at most), computed now: what follows reads these and not the corpus again."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def searched_question(question: str, change: Change | None, expansion: Sequence[str] = ()) -> str:
    """Changed text first, for it ranks hits in a review; all cut to a bound; related terms last."""
    whole = question if change is None else f"{change.text}\n{question}"[:DIFF_TEXT]
    return " ".join([whole, *expansion])


def retrieved(
    files: DataFrame,
    question: str,
    options: Options = Options(),
    change: Change | None = None,
    untracked: DataFrame | None = None,
    expansion: Sequence[str] = (),
    dense_hits: DataFrame | None = None,
    opinions: Callable[[DataFrame], DataFrame] | None = None,
) -> Retrieved:
    """What answers the question within the budget.

    ``files`` has ``path, doc_id, text, bytes, line_count``. With a ``change`` only changed files are searched, exclusions
    of the caller notwithstanding; without one, ``untracked`` files (``path``) count more. ``expansion`` are further
    terms; ``dense_hits`` (``query_id, path, start_line, end_line, similarity``) come in by meaning; ``opinions``
    scores the head of the candidates anew (``query_id, path, start_line, opinion``).
    """
    if not question.strip() or len(question.encode()) > QUESTION_BYTES:
        raise ValueError("the question is empty or too long")
    allowed = glob_filter(F.col("path"), options.globs)
    if change is not None:
        allowed = (allowed | F.col("path").isin(*change.paths)) & glob_filter(F.col("path")) if change.paths else allowed
    wanted = files.where(allowed & ~is_binary(F.col("path")))
    lines = lines_of(wanted)
    asked = searched_question(question, change, expansion)
    terms = lexical.Terms.of(asked)
    if not terms.names:
        raise ValueError("the question has no searchable terms")
    hits = lexical.overfull_spread(lexical.search(wanted, lines, terms), options.max_hits)
    if options.prf and feedback.evidence_is_weak(hits, len(terms.names)):
        found = feedback.feedback_terms(wanted, lexical.file_ranking(hits), terms.names).collect()  # five rows
        if found:
            terms = lexical.Terms.of(" ".join([asked, *(r["token"] for r in found)]))
            hits = lexical.overfull_spread(lexical.search(wanted, lines, terms), options.max_hits)
    if change is not None:
        hits = scope.scope_hits(hits, change.ranges)
    top = bounded(lexical.diverse_hits(hits, options.max_hits))
    if change is None and untracked is not None:
        top = scope.untracked_boost(top, untracked)
    ranked = bounded(lexical.concentration_cliff(lexical.file_ranking(top)))
    paths = [r["path"] for r in ranked.select("path").collect()]  # MAX_FILES at most
    few = wanted.where(F.col("path").isin(*paths) if paths else F.lit(False))
    kept = top.join(F.broadcast(ranked.select("path")), "path", "left_semi")
    blocks = blocks_around(few, kept, options)
    found = chunks.chunk_candidates(kept, ranked, few, blocks, options.budget_tokens, options.context_lines)
    found = found.withColumn("query_id", F.lit(0).cast("long")).withColumn("source", F.lit("lexical"))
    read = few
    if dense_hits is not None:
        found = _fused(found, dense_hits, wanted, options.budget_tokens)
        read = dense_index.with_recalled(few, wanted.join(F.broadcast(dense_hits.select("path").distinct()), "path", "left_semi"))
    candidates = chunks.rerank(found, opinions(found)) if opinions is not None else found
    floored = chunks.relevance_floor(candidates, options.min_score_percent)
    packed = chunks.mmr_pack(floored, options.budget_tokens, options.mmr_lambda)
    summary = assembly.result_summary(packed, candidates, read, terms.names)
    out = assembly.explained(packed, terms.names) if options.why else packed.drop("mask", "source")
    return Retrieved(out, summary, assembly.evidence_documents(packed, read))


def blocks_around(files: DataFrame, hits: DataFrame, options: Options) -> DataFrame:
    """``path, line_no, start_line, end_line`` of the block around each hit, as the options have it."""
    if options.by_definition:
        return definitions.enclosing_definition(files, lines_of(files), hits, options.max_block_lines)
    return structure.enclosing_block(lines_of(files), hits, options.max_block_lines)


def _fused(found: DataFrame, dense_hits: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """The candidates and the region that comes in by meaning, with its content."""
    split = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    own = files.join(F.broadcast(dense_hits.select("path").distinct()), "path").select("path", split.alias("lines"))  # some dozen hits
    sized = dense_hits.join(own, "path").withColumn("line_count", F.size("lines")).withColumn("content", numbered_range(F.col("lines"), F.col("start_line"), F.col("end_line")))
    sized = sized.withColumn("estimated_tokens", (estimate_tokens(F.col("content")) + estimate_tokens(F.col("path")) + ENVELOPE_TOKENS).cast("long")).drop("lines")
    key = ["query_id", "path", "start_line", "end_line"]
    fused = dense.dense_fusion(found.select(*key, "score"), sized.select(*key, "similarity", "line_count", "estimated_tokens"), budget)
    new = fused.join(found.select(*key), key, "left_anti").join(sized.select(*key, "estimated_tokens", "content"), key)
    return found.unionByName(new.withColumn("mask", F.lit(0)).withColumn("source", F.lit("dense")))


def retrieve(files: DataFrame, question: str, options: Options = Options(), changes: DataFrame | None = None) -> DataFrame:
    """The delivered chunks alone: ``path, start_line, end_line, score, estimated_tokens, content, position``."""
    return retrieved(files, question, options, None if changes is None else Change(changes)).chunks.drop("query_id")
