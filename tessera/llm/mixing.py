"""Mixing sources to target weights.

The words of a source, its documents in a fixed order, are packed into blocks of ``block_words``. Output
shards draw how many of their slots each source fills from a multinomial over what the sources still owe, so
that the draws of all shards add up to the sources' targets. A slot's running number within its source goes
through a pseudorandom permutation of the source's block numbers, another one for each pass over the source,
and the blocks are joined by source and number; each keeps its shards and slots. A source's last block is as short as its words are, and of the
block of its last slot only what is needed is taken, so each source meets its target to the word. Everything follows from the seed and the data alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, frugal, small_table

#: Fixed values of the contract: the words of a text, the weights by turns, the share of all words, the limit.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARDS, BUCKET_DOCUMENTS, RUN = 64, 64, 20_000, 65_536
#: Rounds of the permutations, and sources whose values go to all workers (some 16 MB).
ROUNDS, FEW_SOURCES = 6, 200_000


class Plan(NamedTuple):
    """The sources in order of code points, null last."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """``share`` of all words by weight; what exceeds ``limit`` times a source goes to the others by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / whole > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * left / whole
            break
        for i in sorted(over):
            out[i] = float(limit * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def source_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> Plan:
    """One row a source comes to the driver."""
    rows = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted((s for s in rows if s is not None), key=lambda s: s.encode("utf-8"))
    names += [None] if None in rows else []
    sizes = [int(rows[s]) for s in names]
    return Plan(names, sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, limit))


def shard_draws(needs: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """For each shard and source a multinomial draw over what the sources still owe; columns add up to ``needs``."""
    rng = np.random.default_rng(seed)
    owed, out = needs.astype(np.int64).copy(), np.zeros((shards, len(needs)), np.int64)
    for shard in range(shards):
        slots = int(owed.sum()) // (shards - shard)
        while slots and owed.sum():
            drawn = np.minimum(rng.multinomial(slots, owed / owed.sum()), owed)
            out[shard] += drawn
            owed -= drawn
            slots -= int(drawn.sum())
    return out


class Permutation(NamedTuple):
    """A pseudorandom order of ``range(n)``: a Feistel network over the next even number of bits, walked on until it stays inside."""

    n: int
    keys: tuple[int, ...]

    @classmethod
    def of(cls, n: int, *seed: int) -> Permutation:
        return cls(n, tuple(int(k) for k in np.random.default_rng([*seed, n]).integers(1 << 63, size=ROUNDS)))

    def _round(self, half: np.ndarray, key: int, bits: int) -> np.ndarray:
        x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << bits) - 1)

    def _walk(self, values: np.ndarray, backwards: bool) -> np.ndarray:
        bits = max(1, ((self.n - 1).bit_length() + 1) // 2)
        mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
        out = np.asarray(values).astype(np.uint64)
        open_ = np.arange(len(out))
        while len(open_):
            left, right = out[open_] >> shift, out[open_] & mask
            for key in self.keys[::-1] if backwards else self.keys:
                if backwards:
                    left, right = right ^ self._round(left, key, bits), left
                else:
                    left, right = right, left ^ self._round(right, key, bits)
            out[open_] = (left << shift) | right
            open_ = open_[out[open_] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def forward(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, False)

    def backward(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, True)


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key, copy``: the words of every row; a hash of the text and a number tell rows of one id apart.

    So rows without an id are dealt by their texts, and which row is which does not change when they are numbered again.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("key"))
    return sized.withColumn("copy", copy_number())


def copy_number() -> Column:
    return F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("source"))


#: What names a row.
ROW = ("doc_id", "key", "copy")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["key"] == right["key"]) & (left["copy"] == right["copy"])


def plan_table(spark, plan: Plan, **values: list) -> DataFrame:
    """The plan as rows ``of`` (the source), ``number`` and ``values``."""
    kinds = {n: pa.float64() if v and isinstance(v[0], float) else pa.int64() for n, v in values.items()}
    return small_table(spark, list(zip(plan.sources, range(len(plan.sources)), *values.values(), strict=True)), of=pa.string(), number=pa.int32(), **kinds)


def with_plan(rows: DataFrame, table: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` with their source's values; a plan of few sources goes to the rows, so that a hot source stays where it is."""
    table = F.broadcast(table) if len(plan.sources) <= FEW_SOURCES else table
    return rows.join(table, rows["source"].eqNullSafe(table["of"])).drop("of")


def placed(sized: DataFrame, rows: int) -> DataFrame:
    """``sized`` with the words of its source that come before it (``start``).

    Sources are cut into buckets by a hash of the row; the running sum within a bucket and the sums of the buckets
    before give the place, so that a hot source is spread over many tasks.
    """
    buckets = max(1, -(-rows // BUCKET_DOCUMENTS))
    cut = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    sums = cut.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("start_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return cut.join(sums, ["number", "bucket"]).select(*ROW, "number", "size", (F.col("start_in") + F.col("base")).alias("start"))


class Draw(NamedTuple):
    """How a source is drawn: its blocks, the slots it fills, and what is left off the block of its last slot.

    Words of the source from ``low`` to ``high`` (its own numbering) are not taken by its last slot.
    """

    blocks: int
    slots: int
    turns: list[Permutation]
    low: int
    high: int


def source_draw(size: int, target: float, seed: int, block_words: int) -> Draw:
    """As many slots as hold ``target`` words, the short last block at its true size; of the last slot's block what is needed."""
    blocks = -(-size // block_words)
    turns = [Permutation.of(max(blocks, 1), seed, t) for t in range(LIMIT)]
    wanted = min(round(target), LIMIT * size)
    if not wanted:
        return Draw(blocks, 0, turns, 0, 0)
    turn, left = divmod(wanted, size)
    if not left:
        return Draw(blocks, turn * blocks, turns, 0, 0)
    lack = blocks * block_words - size
    # The slot of the pass that draws the short block.
    short = int(turns[turn].backward([blocks - 1])[0])
    slots = -(-left // block_words)
    if short < slots:
        slots = -(-(left + lack) // block_words)
    over = slots * block_words - (lack if short < slots else 0) - left
    block = int(turns[turn].forward([slots - 1])[0])
    high = min((block + 1) * block_words, size)
    return Draw(blocks, turn * blocks + slots, turns, high - over, high)


def drawn_slots(spark, drawing: list[Draw], seed: int, shards: int) -> DataFrame:
    """``number, block, shard, slot``: which block of its source each slot of each output shard takes."""
    draws = shard_draws(np.array([d.slots for d in drawing], dtype=np.int64), shards, seed)
    before = np.cumsum(draws, axis=0) - draws
    runs = [(s, k, int(before[k, s]), int(draws[k, s])) for k in range(shards) for s in range(len(drawing)) if draws[k, s]]
    runs = small_table(spark, runs, number=pa.int32(), shard=pa.int32(), at=pa.int64(), n=pa.int64()).repartition(max(1, min(len(runs), int(draws.sum()) // 200_000)))
    # Slots by runs of bounded length, which the workers put through the permutations.
    runs = runs.select("number", "shard", F.col("at"), F.col("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    runs = runs.select("number", "shard", (F.col("at") + F.col("run") * RUN).alias("first"), (F.least((F.col("run") + 1) * RUN, F.col("n")) - F.col("run") * RUN).alias("n"))
    blocks, turns = [d.blocks for d in drawing], [d.turns for d in drawing]

    def run(batches):
        for batch in batches:
            for number, shard, first, n in zip(*(batch.column(c).to_pylist() for c in ("number", "shard", "first", "n")), strict=True):
                slot = first + np.arange(n)
                turn, place = np.divmod(slot, blocks[number])
                block = np.empty(n, np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = turns[number][t].forward(place[turn == t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(block), pa.array(np.full(n, shard, np.int32)), pa.array(slot)], ["number", "block", "shard", "slot"])

    return runs.mapInArrow(frugal(run), "number int, block long, shard int, slot long")


def mix_blocks(sized: DataFrame, plan: Plan, rows: int, seed: int = 17, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``doc_id, key, copy, first, last, places``: words ``first`` to ``last`` (from 0, last excluded) of a row are taken at each of ``places`` (``shard, slot``).

    They lie in one block. Every source gives its target, to the nearest word. Ordered by shard, then source and slot,
    the pieces are the shards' contents.
    """
    spark = sized.sparkSession
    drawing = [source_draw(s, t, seed * 1000 + i, block_words) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))]
    drawn = drawn_slots(spark, drawing, seed, shards).groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "shard"))).alias("places"))  # LIMIT at most
    table = plan_table(spark, plan, low=[d.low for d in drawing], high=[d.high for d in drawing], last_slot=[d.slots - 1 for d in drawing])
    parts = placed(with_plan(sized.where("size > 0"), table, plan), rows)
    parts = parts.select(*ROW, "number", "start", "size", F.explode(F.sequence((F.col("start") / block_words).cast("long"), ((F.col("start") + F.col("size") - 1) / block_words).cast("long"))).alias("block"))
    first = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    parts = parts.select(*ROW, "number", "block", "start", first.alias("first"), last.alias("last"))
    # The planner takes the slots for small, as it does not see how many rows they become: no broadcast.
    met = parts.join(drawn.hint("merge"), ["number", "block"])
    few = F.broadcast(table.drop("of")) if len(plan.sources) <= FEW_SOURCES else table.drop("of")
    met = met.join(few, "number")
    # What is left off a source's last slot is a part of one block: there words before, within and after it are told apart.
    low = F.least(F.greatest(F.col("low") - F.col("start"), F.col("first")), F.col("last"))
    high = F.least(F.greatest(F.col("high") - F.col("start"), F.col("first")), F.col("last"))
    met = met.withColumn("less", F.filter("places", lambda p: p["slot"] != F.col("last_slot"))).withColumn("low", low).withColumn("high", high)
    piece = lambda a, b, places: F.struct(F.col(a).alias("first"), F.col(b).alias("last"), F.col(places).alias("places"))
    pieces = F.when(F.col("low") >= F.col("high"), F.array(piece("first", "last", "places"))).otherwise(F.array(piece("first", "low", "places"), piece("low", "high", "less"), piece("high", "last", "places")))
    return met.select(*ROW, F.inline(pieces)).where("first < last and size(places) > 0")


def mixture(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards``, one row for each row of ``docs``.

    ``shards`` are the output shards in which words of the row stand. A null or blank text has size 0, nothing taken and
    no shards. Repeated rows of one id are told apart by text and number and each takes its own words. A null source is a
    source of its own, the last; rows without an id are rows like others. No rows give no rows.
    """
    sized = cut(sized_documents(docs))
    plan = source_plan(sized)
    taken = mix_blocks(sized, plan, sized.count(), seed, block_words, shards) if plan.sources else None
    if taken is None:
        return sized.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<int>").alias("shards"))
    words = F.sum((F.col("last") - F.col("first")) * F.size("places")).alias("taken")
    of = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("places", lambda p: p["shard"]))))).alias("shards")
    taken = taken.groupBy(*ROW).agg(words, of)
    rows = with_plan(sized, plan_table(sized.sparkSession, plan, source_size=plan.sizes, target=plan.targets), plan)
    joined = rows.join(taken, same_row(rows, taken), "left")
    return joined.select(rows["doc_id"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
