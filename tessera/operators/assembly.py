"""What a retrieval returns besides its chunks: matched terms, totals, evidence documents and usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import BUDGET_TOKENS, CONTEXT_LINES, ENVELOPE_TOKENS
from tessera.functions.text import decode_terms, estimate_tokens, is_trivial, numbered_range


def explained(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """``chunks`` with ``matched_terms``, the terms that their ``mask`` names; none for chunks that came in by meaning."""
    return chunks.withColumn("matched_terms", decode_terms(F.col("mask"), terms)).drop("mask")


def result_summary(chunks: DataFrame, candidates: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """One row for each query with candidates: terms, chunks, tokens, whether candidates were left out, and the bytes of all files that were read.

    ``chunks`` are those delivered, ``candidates`` all before floor and budget, ``files`` (``path, bytes``) what was loaded.
    """
    given = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("estimated_tokens").alias("estimated_tokens"))
    every = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("available"))
    read = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("baseline_bytes"))  # one row
    rows = every.join(given, "query_id", "left").crossJoin(read).fillna(0, ["chunks", "estimated_tokens"])
    names = F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() as array<string>)")
    return rows.select("query_id", F.lit(1).alias("version"), names.alias("query_terms"), "chunks", "estimated_tokens", (F.col("chunks") < F.col("available")).alias("truncated"), "baseline_bytes")


def evidence_documents(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``query_id, path, bytes, line_count, numbered_content, allowed_ranges``: the delivered chunks of each file, in the order delivered."""
    parts = F.array_sort(F.collect_list(F.struct("position", "start_line", "end_line", "content")))
    grouped = chunks.groupBy("query_id", "path").agg(parts.alias("parts"))
    rows = grouped.join(files.select("path", "line_count"), "path")
    bytes_ = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["content"]))
    ranges = F.transform("parts", lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    return rows.select("query_id", "path", bytes_.alias("bytes"), "line_count", F.array_join(F.transform("parts", lambda x: x["content"]), "\n").alias("numbered_content"), ranges.alias("allowed_ranges"))


def merged_usage(usages: DataFrame) -> DataFrame:
    """Usage of several calls (``call_id, prompt_tokens, completion_tokens, total_tokens, cost``) by call: a sum where any is known, else null."""
    return usages.groupBy("call_id").agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cost")])


def token_drift(chunks: DataFrame) -> DataFrame:
    """The chunks whose ``estimated_tokens`` are not what their content and path take, with ``recomputed``."""
    again = estimate_tokens(F.col("content")) + estimate_tokens(F.col("path")) + ENVELOPE_TOKENS
    return chunks.withColumn("recomputed", again.cast("long")).where("recomputed <> estimated_tokens")


def whole_files(files: DataFrame) -> DataFrame:
    """``path, tokens``: what each file (``path, text``) takes when it is delivered whole, numbered."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    sized = files.select("path", lines.alias("lines"))
    content = numbered_range(F.col("lines"), F.lit(1), F.size("lines"))
    return sized.select("path", (estimate_tokens(content) + estimate_tokens(F.col("path")) + ENVELOPE_TOKENS).cast("long").alias("tokens"))


def targeted_reads(ranked: DataFrame, files: DataFrame, blocks: DataFrame | None = None, budget: int = BUDGET_TOKENS, context: int = CONTEXT_LINES) -> DataFrame:
    """What reading around each ranked hit delivers: ``query_id, position, path, start_line, end_line, tokens``.

    ``ranked`` has ``query_id, position, path, line_no``. A hit's window, or its block where there is one and it is
    not over the budget, loses its trivial ends. In order of position a range is skipped if it meets one taken
    before in its file, or if it does not fit what is left. A query's hits, some hundred, are one group.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    rows = ranked.join(files.select("path", lines.alias("lines")), "path").where("line_no between 1 and size(lines)")
    if blocks is None:
        rows = rows.withColumn("start_line", F.lit(None).cast("int")).withColumn("end_line", F.lit(None).cast("int"))
    else:
        rows = rows.join(blocks.select("path", "line_no", "start_line", "end_line"), ["path", "line_no"], "left")
    own = estimate_tokens(F.col("path")) + ENVELOPE_TOKENS

    def costed(first: Column, last: Column) -> Column:
        body = F.filter(F.sequence(first, last), lambda n: ~is_trivial(F.element_at("lines", n)))
        a = F.when(F.size(body) > 0, F.array_min(body)).otherwise(last)
        b = F.when(F.size(body) > 0, F.array_max(body)).otherwise(last)
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), (estimate_tokens(numbered_range(F.col("lines"), a, b)) + own).cast("long").alias("tokens"))

    window = costed(F.greatest(F.lit(1), F.col("line_no") - context), F.least(F.size("lines"), F.col("line_no") + context))
    block = F.when(F.col("start_line").isNotNull(), costed(F.coalesce("start_line", F.lit(1)), F.coalesce("end_line", F.lit(1))))
    rows = rows.withColumn("w", window).withColumn("s", block)
    pick = F.when(F.col("s").isNotNull() & (F.col("s.tokens") <= budget), F.col("s")).otherwise(F.col("w"))
    asked = F.coalesce(F.col("s"), F.col("w"))  # what must not meet a range taken before
    flat = rows.select("query_id", "position", "path", asked["a"].alias("asked_a"), asked["b"].alias("asked_b"), pick["a"].alias("start_line"), pick["b"].alias("end_line"), pick["tokens"].alias("tokens"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, list[tuple[int, int]]] = {}
        left, kept = budget, []
        for i, r in enumerate(group.sort_values("position", kind="stable").itertuples()):
            meets = any(a <= r.asked_b and r.asked_a <= b for a, b in taken.get(r.path, []))
            if not meets and r.tokens <= left:
                left -= r.tokens
                taken.setdefault(r.path, []).append((r.start_line, r.end_line))
                kept.append(i)
        return group.sort_values("position", kind="stable").iloc[kept].drop(columns=["asked_a", "asked_b"])

    return flat.groupBy("query_id").applyInPandas(run, "query_id long, position int, path string, start_line int, end_line int, tokens long")
