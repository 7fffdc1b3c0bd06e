"""Removal of every byte that lies in a repeated string of ``SPAN`` bytes, by sparse suffix sorting.

Any string of ``SPAN`` bytes has a least ``GRAM``-byte substring by hash (the leftmost of equals): its anchor.
Equal strings have equal anchors at equal places, so only suffixes that start at anchors are sorted. Spark
deals the anchors into buckets by their first ``GRAM`` bytes and drops the buckets with one suffix. A bucket
whose suffixes all stand in one and the same context needs no sorting. The others are sorted deep-shallow:
multikey quicksort to a shallow depth, then blind tries for the groups that still agree. The common prefixes
of neighbours in that order, with the common text in front of the anchors, tell for each suffix which of the
strings around its anchor stand elsewhere too; all of these hold the anchor, so their union is one span.

Contexts that are equal count as one row with a number, before and after each shuffle, so thousands of
copies of a text cost no more than two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, frugal, joined_bytes, slices, text_bytes
from tessera.llm.membership import bitmap, maybe

SPAN, GRAM, SLICE = 200, 64, 1 << 20
BEFORE = SPAN - GRAM  # an anchor stands at most so many bytes after the start of its string
#: Depth that multikey quicksort goes to, the group size from which tries take over, and up to which pairs are compared one by one.
SHALLOW, FEW, PAIRWISE = 48, 4, 24
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_Q = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- deep-shallow sorting


def common_length(a: bytes, b: bytes, start: int = 0) -> int:
    """How long ``a`` and ``b`` agree from their beginning, known to agree up to ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    """A node of a blind trie: only the depth at which its branches differ is kept, and one suffix below it."""

    __slots__ = ("branches", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.branches = depth, leaf, {}


def blind_trie_order(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """``group`` in order, its strings agreeing up to ``depth``: each is put in by a blind search and one comparison."""

    def byte(i: int, d: int) -> int:
        s = strings[i]
        return s[d] if d < len(s) else -1

    ends: dict[int, list[int]] = {}
    root = _Node(-1, group[0])
    ends[group[0]] = [group[0]]
    for i in group[1:]:
        # Down by the branching bytes alone, to some suffix that shares the most with this one.
        node = root
        while node.branches:
            node = node.branches.get(byte(i, node.depth)) or next(iter(node.branches.values()))
        other = node.leaf
        shared = common_length(strings[i], strings[other], depth)
        if shared == len(strings[i]) == len(strings[other]):
            ends[other].append(i)
            continue
        # Down again to the place where the two part.
        node, above, key = root, None, -2
        while node.branches and node.depth < shared:
            above, key = node, byte(i, node.depth)
            node = node.branches[key]
        fresh = _Node(-1, i)
        ends[i] = [i]
        if node.branches and node.depth == shared:
            node.branches[byte(i, shared)] = fresh
        else:
            split = _Node(shared, node.leaf)
            split.branches = {byte(node.leaf, shared): node, byte(i, shared): fresh}
            if above is None:
                root = split
            else:
                above.branches[key] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.branches:
            stack += [node.branches[b] for b in sorted(node.branches, reverse=True)]
        else:
            out += ends[node.leaf]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW, depth: int = 0) -> list[int]:
    """The order of ``strings``: multikey quicksort down to ``shallow``, blind tries below."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), depth)]
    while stack:
        group, d = stack.pop()
        if len(group) <= FEW:
            out += sorted(group, key=strings.__getitem__)
            continue
        if d >= shallow:
            out += blind_trie_order(strings, group, d)
            continue
        at = [strings[i][d] if d < len(strings[i]) else -1 for i in group]
        pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
        less = [i for i, b in zip(group, at, strict=True) if b < pivot]
        same = [i for i, b in zip(group, at, strict=True) if b == pivot]
        more = [i for i, b in zip(group, at, strict=True) if b > pivot]
        # The stack gives the least first.
        if more:
            stack.append((more, d))
        if pivot < 0:
            stack.append((same, shallow))
        else:
            stack.append((same, d + 1))
        if less:
            stack.append((less, d))
    return out


# ---------------------------------------------------------------- anchors


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place (``len - GRAM + 1`` of them), by doubling."""
    h = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(32)
    size, factor = 1, _Q
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor & ((1 << 64) - 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the text, the place in it, the hash and the hash of the context of each anchor."""
    empty = np.zeros(0, np.int64)
    data, starts = joined_bytes(texts)
    if len(data) < SPAN:
        return empty, empty, empty, empty
    h = rolling(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size, wide = 1, BEFORE + 1
    while size * 2 <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if wide > size:
        key = np.minimum(key[: -(wide - size)], key[wide - size :])
    # One entry for each place where a whole string may start; those that cross a text's end are no strings.
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(key)]
    inside = np.arange(len(key)) + SPAN <= starts[text + 1]
    at = (key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = text[inside]
    if not len(at):
        return empty, empty, empty, empty
    fresh = np.r_[True, at[1:] != at[:-1]]
    at, text = at[fresh], text[fresh]
    first, last = np.maximum(at - BEFORE, starts[text]), np.minimum(at + SPAN, starts[text + 1])
    powers = np.multiply.accumulate(np.full(len(data), _Q, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.multiply.accumulate(np.full(len(data), pow(_Q, -1, 1 << 64), np.uint64))
    context = (sums[last] - sums[first]) * back[first] + ((at - first) * 512 + (last - at)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    context ^= context >> np.uint64(31)
    return text, at - starts[text], h[at].view(np.int64), (context * np.uint64(0x94D049BB133111EB)).view(np.int64)


def anchor_rows(texts: DataFrame) -> DataFrame:
    """``gram, context, text_key, at, n`` from ``text_key, text``; copies in a slice are one row with their number."""

    def run(batches):
        for part in slices(batches, size=SLICE):
            keys = part.column("text_key").to_pylist()
            number: dict[int, int] = {}
            for k in keys:
                number[k] = number.get(k, 0) + 1
            own = list(number)
            where = {k: i for i, k in reversed(list(enumerate(keys)))}
            bodies = text_bytes(part.column("text"))
            text, at, gram, context = anchors([bodies[where[k]] for k in own])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), pa.array(np.array(own, np.int64)[text]), pa.array(at.astype(np.int32)), pa.array(np.array(list(number.values()), np.int32)[text])], ["gram", "context", "text_key", "at", "n"])

    return texts.mapInArrow(frugal(run), "gram long, context long, text_key long, at int, n int")


# ---------------------------------------------------------------- buckets


def spans_of_bucket(lefts: list[bytes], rights: list[bytes], numbers: list[int]) -> list[tuple[int, int] | None]:
    """For each distinct context of one anchor, the span around it that repeated strings cover, or None.

    ``lefts`` are reversed. A context that stands ``numbers`` > 1 times is repeated whole.
    """
    m = len(lefts)
    low, high = [1] * m, [0] * m  # no string yet

    def add(i: int, before: int, after: int) -> None:
        if before + after >= SPAN:
            low[i] = min(low[i], -before)
            high[i] = max(high[i], after)

    for i in range(m):
        if numbers[i] > 1:
            add(i, len(lefts[i]), len(rights[i]))
    known = GRAM if len({r[:GRAM] for r in rights}) == 1 else 0  # the anchor, unless two have one hash
    order = deep_shallow_order(rights, known + SHALLOW, known)
    shared = [common_length(rights[a], rights[b], known) for a, b in zip(order, order[1:], strict=False)]
    if m <= PAIRWISE:
        for x in range(m):
            after = SPAN
            for y in range(x + 1, m):
                after = min(after, shared[y - 1])
                if after < GRAM:
                    break
                before = common_length(lefts[order[x]], lefts[order[y]])
                add(order[x], before, after)
                add(order[y], before, after)
    else:
        # For each number of bytes before the anchor: runs of suffixes that share the rest of the string, cut by the bytes before.
        rows = np.frombuffer(b"".join(lefts[i].ljust(BEFORE, b"\0") for i in order), np.uint8).reshape(m, BEFORE)
        length = np.array([len(lefts[i]) for i in order])
        right_length = np.array([len(rights[i]) for i in order])
        gaps = np.array(shared)
        hashed = np.zeros(m, np.uint64)
        for before in range(BEFORE + 1):
            if before:
                hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(_Q) + rows[:, before - 1] + np.uint64(1)
            able = (length >= before) & (right_length >= SPAN - before)
            if able.sum() < 2:
                continue
            run = np.concatenate([[0], np.cumsum(gaps < SPAN - before)]).astype(np.uint64)
            key = (hashed ^ (run * np.uint64(0xC2B2AE3D27D4EB4F)))[able]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(able)[count[inverse] > 1]:
                add(order[k], before, SPAN - before)
    return [(a, b) if a <= 0 else None for a, b in zip(low, high, strict=True)]


def bucket_spans(contexts: DataFrame) -> DataFrame:
    """``gram, context, low, high`` from ``gram, context, n, before, after`` (bytes); a bucket is in one task and ends with its rows."""

    def finish(gram: int, rows: dict[int, tuple[bytes, bytes, int]]) -> tuple[list, ...]:
        found = spans_of_bucket([r[0] for r in rows.values()], [r[1] for r in rows.values()], [r[2] for r in rows.values()])
        kept = [(gram, c, *s) for c, s in zip(rows, found, strict=True) if s]
        return tuple(zip(*kept, strict=True)) if kept else ()

    def run(batches):
        gram, rows = None, {}
        out: list[list] = [[], [], [], []]

        def take(part: tuple) -> None:
            for column, values in zip(out, part, strict=False):
                column.extend(values)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["gram", "context", "low", "high"])
            for column in out:
                column.clear()
            return made

        for part in batches:
            for g, c, n, before, after in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if g != gram:
                    if rows:
                        take(finish(gram, rows))
                    gram, rows = g, {}
                rows[c] = (before, after, n)
            if len(out[0]) > 20_000:
                yield batch()
        if rows:
            take(finish(gram, rows))
        if out[0]:
            yield batch()

    picked = contexts.select("gram", "context", "n", "before", "after").repartition("gram").sortWithinPartitions("gram")
    return picked.mapInArrow(frugal(run), "gram long, context long, low int, high int")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``text_key, spans`` (arrays of start and end) of the texts (``text_key, text``) that have repeated strings.

    A span may reach over a text's ends, where its anchor is near them; whoever applies it cuts it there and
    drops what is then shorter than a string.
    """
    rows = anchor_rows(texts)
    buckets = rows.groupBy("gram").agg(F.sum("n").alias("total"), F.min("context").alias("low"), F.max("context").alias("high")).where("total > 1")
    buckets = buckets.select("gram", (F.col("low") == F.col("high")).alias("one"))
    hits = cut(rows.join(buckets, "gram").groupBy("text_key", "at", "gram", "context", "one").agg(F.sum("n").alias("n")))
    whole = hits.where("one").select("text_key", (F.col("at") - BEFORE).alias("start"), (F.col("at") + SPAN).alias("end"))
    # One place of each context that is to be sorted, and the texts that have them.
    places = hits.where("not one").groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(F.struct("text_key", "at")).alias("place"))
    places = cut(places.select("gram", "context", "n", "place.text_key", "place.at"))
    wanted = places.groupBy("text_key").agg(F.collect_list(F.struct("at", "gram", "context", "n")).alias("places"))

    def contexts(batches):
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text, places in zip(text_bytes(part.column("text")), part.column("places").to_pylist(), strict=True):
                for p in places:
                    at = p["at"]
                    values = (p["gram"], p["context"], p["n"], text[max(0, at - BEFORE) : at][::-1], text[at : at + SPAN])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gram", "context", "n", "before", "after"])

    holders = maybe(texts, "text_key", bitmap(places, "text_key")).where("__maybe").select("text_key", "text")
    fetched = holders.join(wanted, "text_key").select("text", "places").mapInArrow(frugal(contexts), "gram long, context long, n long, before binary, after binary")
    found = bucket_spans(fetched)
    sorted_ = hits.where("not one").join(found, ["gram", "context"]).select("text_key", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("end"))
    return cut(whole.union(sorted_).groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def removed_runs(size: int, spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((max(0, s["start"]), min(size, s["end"])) for s in spans):
        if end - start < SPAN:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: those with repeated strings, with their ``__spans``, and the others."""
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(keyed.select(F.col("__key").alias("text_key"), "text").where(F.octet_length("text") >= SPAN)).toDF("__key", "__spans")
    flagged = maybe(keyed, "__key", bitmap(spans, "__key"))
    joined = flagged.where("__maybe").join(spans, "__key", "left").drop("__key", "__maybe")
    return joined, flagged.where("not __maybe").drop("__key", "__maybe")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for each row of ``docs``.

    A null text is empty; texts shorter than a string lose nothing; repeated rows and equal texts of a
    string's length or more lose all. An empty table gives no rows.
    """
    hit, rest = with_spans(docs.select("doc_id", "text"))

    def work(batches):
        for part in slices(batches):
            rows = []
            for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                runs = removed_runs(len(text), spans or [])
                kept, at = hashlib.sha256(), 0
                for start, end in runs:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                rows.append((doc_id, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = hit.select("doc_id", "text", F.col("__spans").alias("spans")).mapInArrow(frugal(work), SCHEMA)
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return done.union(rest.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long"), zero, zero, F.sha2(text.cast("binary"), 256)))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with repeated strings cut out of ``text``; a character that is cut in two goes whole.

    ``n_chars`` follows the text where the column is there.
    """
    hit, rest = with_spans(docs)
    names = docs.columns

    def shorter(texts, spans):
        out = []
        for text, own in zip(text_bytes(texts), spans.to_pylist(), strict=True):
            at, kept = 0, []
            for start, end in removed_runs(len(text), own or []):
                kept.append(text[at:start])
                at = end
            kept.append(text[at:])
            out.append("".join(k.decode("utf-8", "ignore") for k in kept))
        return pa.array(out, pa.string())

    def work(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([shorter(part.column("text"), part.column("__spans")) if c == "text" else part.column(c) for c in names], names)

    done = hit.select(*names, "__spans").mapInArrow(frugal(work), docs.schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(names).union(rest.select(names))
