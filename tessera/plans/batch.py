"""Retrieval for a table of questions, and how well it finds what is expected."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_binary
from tessera.operators import batch, chunks, corpus, evaluation, lexical
from tessera.plans.retrieve import Options, blocks_around
from tessera.sources.carriers import lines as lines_of
from tessera.sources.files import glob_filter


class Report(NamedTuple):
    """Of an evaluation: first relevant rank of each case, the share of cases within each k, and the mean reciprocal rank."""

    ranks: DataFrame
    hit_at_k: DataFrame
    mrr: DataFrame


def batch_ranked(files: DataFrame, questions: DataFrame, options: Options = Options(), posted: DataFrame | None = None) -> DataFrame:
    """``query_id, path, line_no, mask, score, position``: the top hits of every question."""
    wanted = files.where(glob_filter(F.col("path"), options.globs) & ~is_binary(F.col("path")))
    terms = batch.question_terms(questions)
    found = corpus.corpus_search(wanted, terms, options.max_hits) if posted is None else batch.batch_search(wanted, lines_of(wanted), terms, posted)
    return batch.batch_top(lexical.overfull_spread(found, options.max_hits, ("query_id", "path")), options.max_hits)


def retrieve_batch(files: DataFrame, questions: DataFrame, options: Options = Options(), posted: DataFrame | None = None) -> DataFrame:
    """The delivered chunks of every question: ``query_id, path, start_line, end_line, score, estimated_tokens, content, mask, position``.

    ``questions`` has ``query_id, question``; one that is null, or has no searchable terms or no hits, has no rows. The
    corpus is searched once for all; the top hits and the files that they lie in (``max_hits`` and some dozen a question)
    are kept and read by what follows. Feedback and changes are for single questions.
    """
    top = batch_ranked(files, questions, options, posted).drop("position").persist()
    ranked = batch.batch_cliff(top)
    kept = top.join(ranked.select("query_id", "path"), ["query_id", "path"], "left_semi")
    few = files.join(ranked.select("path").distinct(), "path", "left_semi")
    blocks = blocks_around(few, kept, options)
    found = chunks.chunk_candidates(kept, ranked, few, blocks, options.budget_tokens, options.context_lines)
    return chunks.mmr_pack(chunks.relevance_floor(found, options.min_score_percent), options.budget_tokens, options.mmr_lambda)


def evaluate_batch(delivered: DataFrame, expected: DataFrame) -> Report:
    """How well delivered chunks meet what is ``expected`` (``query_id, path``, with or without ``start_line, end_line``)."""
    ranks = evaluation.first_ranks(delivered.withColumn("rank", F.col("position")), expected)
    return Report(ranks, evaluation.hit_at_k(ranks), evaluation.mrr(ranks))
