"""From hits to chunks, and from chunks to a packed answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import BUDGET_TOKENS, CHUNK_TOKENS, CHUNKS_PER_FILE, CONTEXT_LINES, ENVELOPE_TOKENS, FLOOR_PERCENT, MMR_LAMBDA, RERANK_HEAD, SAME_PATH_SIMILARITY
from tessera.functions.text import content_tokens, estimate_tokens, is_trivial, numbered_range

CHUNK_SCHEMA = "query_id long, path string, start_line int, end_line int, score long, estimated_tokens long, content string"


def trimmed(trivial: list[bool], first: int, last: int) -> tuple[int, int]:
    """A range (from 1) without the trivial lines at its ends; of all-trivial lines the last stays."""
    while first < last and trivial[first - 1]:
        first += 1
    while last > first and trivial[last - 1]:
        last -= 1
    return first, last


def file_ranges(tokens: list[int], own: int, trivial: list[bool], hits: list[tuple[int, int, int]], blocks: dict[int, tuple[int, int]], cap: int, context: int) -> list[tuple[int, int, int, int]]:
    """``first, last, score, mask`` of a file's chunks from its hits (line, mask, score).

    A hit's range is its block without trivial ends, if that costs no more than ``cap``; else the widest window
    around it, its trivial ends left out, that does; without any, the window of no radius. Ranges that meet
    become one while they still fit. Costs come from running sums.
    """
    n, upto = len(tokens), np.concatenate([[0], np.cumsum(tokens)])

    def cost(first: int, last: int) -> int:
        return int(upto[last] - upto[first - 1]) + own

    ranges = []
    for line, _, score in sorted(hits, key=lambda h: (-h[2], h[0])):
        found = trimmed(trivial, *blocks[line]) if line in blocks else None
        if found is None or cost(*found) > cap:
            for radius in range(context, -1, -1):
                found = trimmed(trivial, max(1, line - radius), min(n, line + radius))
                if cost(*found) <= cap:
                    break
        ranges.append((*found, score))
    merged: list[tuple[int, int, int]] = []
    for first, last, score in sorted(ranges, key=lambda r: r[0]):
        if merged and first <= merged[-1][1] + 1 and cost(merged[-1][0], max(merged[-1][1], last)) <= cap:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last), max(merged[-1][2], score))
        else:
            merged.append((first, last, score))
    return [(a, b, score, int(np.bitwise_or.reduce([0, *(m for line, m, _ in hits if a <= line <= b)]))) for a, b, score in merged]


def chunk_candidates(hits: DataFrame, ranked: DataFrame, files: DataFrame, blocks: DataFrame | None = None, budget: int = BUDGET_TOKENS, context: int = CONTEXT_LINES) -> DataFrame:
    """Chunks of the ranked files: each hit's block, or a window around it that fits, merged where they meet and still fit.

    ``hits`` (``path, line_no, mask, score``), ``ranked`` (``path, score``, a few dozen rows after the cliff),
    ``blocks`` (``path, line_no, start_line, end_line``). Merging depends on its order, so the ranges of a file
    are found in one pass over its hits; everything else is built-in expressions. With a ``query_id`` in ``hits``
    and ``ranked`` they are the chunks of many questions, and have it too.
    """
    cap = min(budget, CHUNK_TOKENS)
    keys = ["query_id", "path"] if "query_id" in ranked.columns else ["path"]
    split = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    leaders = ranked.select(*keys, F.col("score").alias("file_score"))
    few = files.join(leaders if len(keys) > 1 else F.broadcast(leaders), "path").withColumn("lines", split)
    each = F.transform("lines", lambda x, i: estimate_tokens(F.concat((i + 1).cast("string"), F.lit(": "), x)))
    few = few.withColumn("own", estimate_tokens(F.col("path")) + ENVELOPE_TOKENS)
    if blocks is not None:
        hits = hits.join(blocks.select("path", "line_no", "start_line", "end_line"), ["path", "line_no"], "left")
    else:
        hits = hits.withColumn("start_line", F.lit(None).cast("int")).withColumn("end_line", F.lit(None).cast("int"))
    item = F.struct(*[F.col(c).cast("long").alias(c) for c in ("line_no", "mask", "score", "start_line", "end_line")])
    asked = hits.groupBy(*keys).agg(F.collect_list(item).alias("hits"))
    shape = few.join(asked, keys).select(F.struct(*keys).alias("key"), F.col("own").cast("long"), each.alias("tokens"), F.transform("lines", is_trivial).alias("trivial"), "hits")

    def run(batches):
        for batch in batches:
            chosen, out = [], [[], [], [], []]
            for place, (own, tokens, trivial, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("own", "tokens", "trivial", "hits")), strict=True)):
                snaps = {h["line_no"]: (h["start_line"], h["end_line"]) for h in found if h["start_line"] is not None}
                for row in file_ranges(tokens, own, trivial, [(h["line_no"], h["mask"], h["score"]) for h in found], snaps, cap, context):
                    chosen.append(place)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(chosen, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["key", "start_line", "end_line", "hit_score", "mask"])

    kind = shape.schema["key"].dataType.simpleString()
    ranges = shape.mapInArrow(run, f"key {kind}, start_line int, end_line int, hit_score long, mask int").select("key.*", "start_line", "end_line", "hit_score", "mask")
    parts = ranges.join(few.select(*keys, "lines", "own", "file_score"), keys)
    score = F.col("hit_score") * (10 + F.least(F.greatest(F.bit_count("mask") - 1, F.lit(0)), F.lit(3))) + F.floor(F.col("file_score") / 4)
    content = numbered_range(F.col("lines"), F.col("start_line"), F.col("end_line"))
    return parts.withColumn("content", content).select(*keys, "start_line", "end_line", score.cast("long").alias("score"), (estimate_tokens(F.col("content")) + F.col("own")).alias("estimated_tokens"), "content", "mask")


def relevance_floor(chunks: DataFrame, percent: int = FLOOR_PERCENT) -> DataFrame:
    """The chunks (``query_id, score``) that reach a share of their query's best score."""
    top = chunks.groupBy("query_id").agg(F.max("score").alias("top"))
    return chunks.join(top, "query_id").where((F.col("top") <= 0) | (F.col("score") * 100 >= F.col("top") * percent)).drop("top")


def greedy_pack(chunks: pd.DataFrame, budget: int, weight: float = MMR_LAMBDA) -> pd.DataFrame:
    """Again and again the chunk that fits and gains most: relevance less likeness to what is in already."""
    rows = chunks.sort_values(["score", "path", "start_line"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    top = max(1, int(rows["score"].max())) if len(rows) else 1
    paths, cost = rows["path"].to_numpy(), rows["estimated_tokens"].to_numpy()
    relevance = rows["score"].to_numpy() / top
    words = [frozenset(w) for w in rows["words"]]
    likeness, open_ = np.zeros(len(rows)), np.ones(len(rows), bool)
    used, chosen, per_file = 0, [], {}
    while open_.any() and used < budget:
        able = open_ & (used + cost <= budget) & np.array([per_file.get(p, 0) < CHUNKS_PER_FILE for p in paths])
        if not able.any():
            break
        value = np.where(able, weight * relevance - (1 - weight) * likeness, -np.inf)
        best = -1
        for i in np.flatnonzero(able):
            if best < 0 or value[i] > value[best] + np.finfo(float).eps:
                best = int(i)
        chosen.append(best)
        open_[best] = False
        used += int(cost[best])
        per_file[paths[best]] = per_file.get(paths[best], 0) + 1
        for i in np.flatnonzero(open_):
            union = len(words[i] | words[best])
            alike = len(words[i] & words[best]) / union if union else 0.0
            likeness[i] = max(likeness[i], alike, SAME_PATH_SIMILARITY if paths[i] == paths[best] else 0.0)
    out = rows.iloc[chosen].copy()
    out["position"] = np.arange(1, len(chosen) + 1)
    return out


def mmr_pack(chunks: DataFrame, budget: int = BUDGET_TOKENS, weight: float = MMR_LAMBDA) -> DataFrame:
    """``chunks`` (``query_id, path, start_line, end_line, score, estimated_tokens, content``) that fit each query's budget, in the order chosen.

    A step depends on the ones before it, so a query's candidates, some hundred after the floor, are packed in
    one task; queries are packed side by side.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return greedy_pack(group, budget, weight).drop(columns="words")

    extra = [(c, k) for c, k in (("mask", "int"), ("source", "string")) if c in chunks.columns]
    wordy = chunks.select(*[c.split()[0] for c in CHUNK_SCHEMA.split(", ")], *[c for c, _ in extra], content_tokens(F.col("content")).alias("words"))
    return wordy.groupBy("query_id").applyInPandas(run, ", ".join([CHUNK_SCHEMA, *[f"{c} {k}" for c, k in extra], "position int"]))


def rerank(chunks: DataFrame, scored: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """The head of each query's ranking by a scorer's opinion (``query_id, path, start_line, opinion``); the rest stays."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line")
    ranked = chunks.withColumn("rank", F.row_number().over(order))
    tail = F.coalesce(F.max(F.when(F.col("rank") > head, F.col("score"))).over(Window.partitionBy("query_id")), F.lit(0))
    size = F.sum((F.col("rank") <= head).cast("int")).over(Window.partitionBy("query_id"))
    rows = ranked.withColumn("tail", tail).withColumn("n", size).join(scored, ["query_id", "path", "start_line"], "left")
    in_head = (F.col("rank") <= head) & (F.col("n") >= 2)
    opinion = F.row_number().over(Window.partitionBy("query_id", in_head).orderBy(F.desc(F.coalesce("opinion", F.lit(0.0))), "rank"))
    rows = rows.withColumn("score", F.when(in_head, F.col("tail") + F.col("n") - opinion + 1).otherwise(F.col("score")))
    return rows.select(*chunks.columns)
