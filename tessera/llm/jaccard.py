"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams, as 64-bit hashes; documents with one set are one class. The
global order of n-grams is by hash, with those last that many documents hold (found by counting every document;
kept as a bitmap of a fixed size). Any order gives exact results, this one keeps common passages out of the way.
Two sets that are similar enough share an n-gram in their prefixes, so the classes that share one are
candidates. For candidates the order is cut into fragments; the overlap is counted in each fragment separately
and summed per pair.

N-grams travel as blobs of whole hash ranges ("buckets"), so that rows stay few. A short list of classes that
share an n-gram gives all its pairs; the members of longer lists are kept as rows. Those members whose counts
leave no room for a link go. The others meet their lists' hubs first, then only pairs of different components
are left to look at, for which a class looks into no more of its lists than needed: a large group of near copies
is never paired with itself, yet no link that matters for a component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, few_tasks, frugal, joined_bytes, map_texts, slices, text_bytes
from tessera.llm.components import components
from tessera.llm.membership import bitmap, maybe

WORDS, PERCENT, FRAGMENTS = 5, 75, 2
#: An n-gram is common from so many documents on. At most so many go last in the order, those of most documents.
COMMON_DOCUMENTS, COMMON_GRAMS = 4, 1 << 22
#: Places of the common n-grams' bitmap, as a power of two (16 MB).
COMMON_BITS = 27
#: N-grams of a bucket on average, and n-grams or postings that a task holds before it writes them out.
BUCKET_GRAMS, HELD_GRAMS, HELD_POSTINGS = 1_000_000, 1_000_000, 250_000
#: An n-gram of so many documents has its postings dealt to several buckets; with more than 2^20 such n-grams, a larger count.
HOT_DOCUMENTS = 20_000
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 6
#: After the first hub: hubs of a list, and those of them that a class is compared with.
MORE_HUBS = (8, 4)
#: Of the pairs across components that a class looks for, so many are compared before the others.
FIRST_PAIRS = 8
#: Words of 64 bits of a set's sketch.
SKETCH_WORDS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct n-gram hashes in order; the whole sequence where it has fewer words."""
    data, starts = joined_bytes([t + b"\n" for t in texts])
    white = WHITE[data]
    begin = np.flatnonzero(~white & np.r_[True, white[:-1]])
    end = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    q = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(len(data), q, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.multiply.accumulate(np.full(len(data), pow(int(q), -1, 1 << 64), np.uint64))
    word = mixed((sums[end] - sums[begin]) * back[begin]) if len(begin) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(begin, starts)
    grams = np.zeros(len(word), np.uint64)
    for k in range(min(words, len(word))):
        grams[: len(word) - k] = grams[: len(word) - k] * q + word[k:]
    grams = mixed(grams)
    out = []
    for i in range(len(texts)):
        first, last = bounds[i], bounds[i + 1]
        if last - first >= words:
            out.append(np.unique(grams[first : last - words + 1]))
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for w in word[first:last]:
                whole = whole * q + w
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set: classes go by the first, the second tells when it stands for two sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        grams, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        for k in (0, 1):
            each = mixed(grams * np.uint64(3 + 2 * k) + np.uint64(2 * seed + k + 1))
            crossed = np.bitwise_xor.reduceat(each, starts)
            out[k, full] = mixed(crossed + np.add.reduceat(each, starts) * np.uint64(0x9E3779B97F4A7C15))
    return out[0].view(np.int64), out[1].view(np.int64)


class Order(NamedTuple):
    """The global order of n-grams, and how they are dealt into buckets."""

    bits: int  # 2^bits buckets by the hash's first bits
    common: np.ndarray  # packed bits of the n-grams that go last, by their first COMMON_BITS bits; empty for none
    hot: np.ndarray  # first bits + 32 bits of n-grams with more than one bucket, ascending
    parts: np.ndarray  # how many buckets each has

    def late(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(grams), bool)
        at = grams >> np.uint64(64 - COMMON_BITS)
        return (self.common[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def buckets(self, grams: np.ndarray, names: np.ndarray) -> np.ndarray:
        out = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.hot):
            key = grams >> np.uint64(32 - self.bits)
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            is_hot = np.flatnonzero(self.hot[at] == key)
            first = (1 << self.bits) + np.cumsum(self.parts) - self.parts
            out[is_hot] = first[at[is_hot]] + (names[is_hot].view(np.uint64) % self.parts[at[is_hot]].astype(np.uint64)).astype(np.int64)
        return out


def prefixes(sets: list[np.ndarray], order: Order, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of all sets in the global order, as many as a set can lose without losing the similarity, and one; and their set's number."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    size = sizes + (-percent * sizes) // 100 + 1
    late = order.late(grams)
    before = np.r_[0, np.cumsum(~late)]
    start = (np.cumsum(sizes) - sizes)[of]
    early_rank = before[:-1] - before[start]
    early = before[np.cumsum(sizes)] - before[np.cumsum(sizes) - sizes]
    rank = np.where(late, early[of] + (np.arange(len(grams)) - start) - early_rank, early_rank)
    kept = rank < size[of]
    return grams[kept], of[kept]


def scan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``id, n, name, other`` of each document: set size and two names of its set."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_sets(text_bytes(part.column("text")))
        name, other = fingerprints(sets, seed)
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(name), pa.array(other)], ["id", "n", "name", "other"])

    return map_texts(docs.select("doc_id", "text"), work, "id long, n long, name long, other long")


def distinct_sets(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The sets with n-grams and their names, of about ``held`` n-grams together; in one such lot every set once."""
    sets, names, size, seen = [], [], 0, set()
    for part in slices(batches):
        some = gram_sets(text_bytes(part.column("text")))
        for s, name in zip(some, fingerprints(some)[0].tolist(), strict=True):
            if len(s) and name not in seen:
                seen.add(name)
                sets.append(s)
                names.append(name)
                size += len(s)
        if size >= held:
            yield sets, np.array(names, np.int64)
            sets, names, size, seen = [], [], 0, set()
    if sets:
        yield sets, np.array(names, np.int64)


def blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket, with its part of every column as bytes; ``bucket`` ascends."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    last = np.r_[first[1:], len(bucket)]
    out = [pa.array(bucket[first], pa.int64())]
    for values in columns.values():
        out.append(pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def gathered(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[tuple]:
    """Of rows sorted by bucket: each bucket's number and its columns, put together again."""
    at, held = None, []

    def whole() -> tuple:
        return at, *(np.concatenate([np.frombuffer(x, k) for x in column]) for column, k in zip(zip(*held, strict=True), kinds, strict=True))

    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if held and bucket != at:
                yield whole()
                held = []
            at = bucket
            held.append([batch.column(1 + k)[i].as_buffer() for k in range(len(kinds))])
    if held:
        yield whole()


def common_order(docs: DataFrame, total: int, seed: int = 0) -> Order:
    """Counts every n-gram of all documents and puts the common ones last.

    To the driver come at most ``COMMON_GRAMS`` places of the bitmap (16 MB) and 2^20 hot n-grams. An n-gram goes
    by 32 bits beside its bucket's: where two coincide their counts add up, which changes the work, not the result.
    """
    bits = min(24, max(1, int(total // BUCKET_GRAMS).bit_length()))
    hot_documents = max(HOT_DOCUMENTS, total >> 20)

    def count(batches):
        for sets, _ in distinct_sets(batches, HELD_GRAMS):
            grams, times = np.unique(np.concatenate(sets), return_counts=True)
            yield blobs((grams >> np.uint64(64 - bits)).astype(np.int64), {"rest": (grams >> np.uint64(32 - bits)).astype(np.uint32), "times": np.minimum(times, 65535).astype(np.uint16)})

    def add_up(batches):
        for bucket, rest, times in gathered(batches, [np.uint32, np.uint16]):
            by = np.argsort(rest, kind="stable")
            rest = rest[by]
            first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
            rest, n = rest[first].astype(np.uint64), np.add.reduceat(times[by].astype(np.int64), first)
            key = (np.uint64(bucket) << np.uint64(32)) | rest
            place = (key >> np.uint64(32 + bits - COMMON_BITS)).astype(np.uint32)
            level = np.where(n >= COMMON_DOCUMENTS, np.log2(n).astype(np.int32), -1)
            rows = [(int(k), len(p := np.unique(place[level == k])), p.tobytes(), b"") for k in np.unique(level[level >= 0])]
            if len(h := np.flatnonzero(n > hot_documents)):
                rows.append((-1, len(h), key[h].tobytes(), n[h].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["level", "n", "keys", "counts"])

    counts = docs.select("text").mapInArrow(frugal(count), "bucket long, rest binary, times binary")
    found = cut(counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(add_up), "level int, n long, keys binary, counts binary"))
    left, least = COMMON_GRAMS, None
    for row in found.where("level >= 0").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        left -= row["n"]
        if left < 0:
            break
        least = row["level"]
    common = np.zeros(0, np.uint8)
    if least is not None:
        keys = found.where(F.col("level") >= least).select("keys").toArrow().column("keys").to_pylist()
        places = np.unique(np.concatenate([np.frombuffer(k, np.uint32) for k in keys]))
        byte = places >> np.uint32(3)
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        common = np.zeros(1 << (COMMON_BITS - 3), np.uint8)
        common[byte[first]] = np.bitwise_or.reduceat(np.uint8(1) << (places & np.uint32(7)).astype(np.uint8), first)
    hot = found.where("level = -1").select("keys", "counts").toArrow().to_pylist()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in hot)])
    parts = np.concatenate([np.zeros(0, np.int64), *(-(-np.frombuffer(r["counts"], np.int64) // hot_documents) for r in hot)])
    by = np.argsort(keys)
    return Order(bits, common, keys[by], parts[by])


def postings(docs: DataFrame, order: Order, seed: int = 0) -> DataFrame:
    """The n-grams of the prefix of every document's set, by bucket: ``bucket, gram, name, n``."""

    def run(batches):
        for sets, names in distinct_sets(batches, HELD_POSTINGS * 100 // (100 - PERCENT)):
            gram, of = prefixes(sets, order)
            name, n = fingerprints(sets, seed)[0][of], np.array([len(s) for s in sets], np.int32)[of]
            bucket = order.buckets(gram, name)
            by = np.argsort(bucket, kind="stable")
            yield blobs(bucket[by], {"gram": gram[by], "name": name[by], "n": n[by]})

    return docs.select("text").mapInArrow(frugal(run), "bucket long, gram binary, name binary, n binary")


def lists(gram: np.ndarray, name: np.ndarray, n: np.ndarray, all_long: bool = False) -> tuple[np.ndarray, ...]:
    """From a bucket's postings: ``kind`` 0 for pairs of short lists and how many n-grams they share, 1 for members of long lists and their sizes."""
    by = np.lexsort((name, gram))
    gram, name, n = gram[by], name[by], n[by]
    keep = np.r_[True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])][: len(gram)]
    gram, name, n = gram[keep], name[keep], n[keep]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    count = np.diff(np.r_[first, len(gram)])
    of = np.repeat(count, count)
    some = (of > 1) | all_long
    gram, name, n, of = gram[some], name[some], n[some], of[some]
    long = (of > SHORT_LIST) | all_long
    a, b = [], []
    for k in range(1, SHORT_LIST):
        if k < len(gram):
            ok = (gram[:-k] == gram[k:]) & ~long[k:]
            ok &= 100 * np.minimum(n[:-k], n[k:]).astype(np.int64) >= PERCENT * np.maximum(n[:-k], n[k:]).astype(np.int64)
            a.append(name[:-k][ok])  # names ascend in a list
            b.append(name[k:][ok])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.r_[at, len(a)])
    kind = np.repeat(np.array([0, 1], np.int32), [len(at), int(long.sum())])
    return kind, np.concatenate([a[at], gram[long].view(np.int64)]), np.concatenate([b[at], name[long]]), np.concatenate([shared, n[long]]).astype(np.int64)


def pairs_and_members(rows: DataFrame, order: Order) -> DataFrame:
    """``kind, a, b, c`` of all buckets, see ``lists``; a pair may come from several buckets."""
    whole = 1 << order.bits

    def run(batches):
        for bucket, gram, name, n in gathered(batches, [np.uint64, np.int64, np.int32]):
            out = lists(gram, name, n, bucket >= whole)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["kind", "a", "b", "c"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run), "kind int, a long, b long, c long")


def may_be_similar(shared: Column, one: Column, other: Column) -> Column:
    """Whether sets of two sizes, whose prefixes share at most so many n-grams, may be similar."""
    rest = F.greatest(F.ceil(one * PERCENT / 100), F.ceil(other * PERCENT / 100)) - 1
    return (100 + PERCENT) * (shared + rest) >= PERCENT * (one + other)


def possible(pairs: DataFrame, sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """The pairs (``a, b, c``) that may be similar, by the n-grams that their prefixes can share.

    Shared n-grams up to the end of the prefix that ends first are in both prefixes; beyond it there are at most
    what the set has left. ``c`` counts those of short lists; of long ones two sets share at most as many as
    either is in.
    """
    of = sizes.select("name", "n").join(weights.select("name", "lists"), "name", "left").select("name", "n", F.coalesce("lists", F.lit(0)).alias("lists"))
    pairs = pairs.join(of.toDF("a", "na", "ma"), "a").join(of.toDF("b", "nb", "mb"), "b")
    return pairs.where(may_be_similar(F.col("c") + F.least("ma", "mb"), F.col("na"), F.col("nb"))).select("a", "b", "c")


def open_to_links(members: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """The members (``gram, name, n, lists, spare``) that may be similar to another class of the list, by the same bound.

    What a set can share with another is least short of what it needs where their sizes differ most, so the
    smallest and the largest size of the list decide. ``spare`` is how many of the n-grams that its prefix shares
    with any class it can do without. There are at most ``most`` members.
    """
    span = few_tasks(members.groupBy("gram").agg(F.min("n").alias("low"), F.max("n").alias("high")), most)
    rows = members.join(weights, "name").join(span, "gram")
    low, high = F.greatest("low", F.ceil(F.col("n") * PERCENT / 100)), F.least("high", F.floor(F.col("n") * 100 / PERCENT))
    rest = lambda other: F.greatest(F.ceil(F.col("n") * PERCENT / 100), F.ceil(other * PERCENT / 100))
    spare = lambda other: F.col("shared") + rest(other) - F.ceil(PERCENT * (F.col("n") + other) / (100 + PERCENT))
    return rows.withColumn("spare", F.greatest(spare(low), spare(high))).where("spare >= 0").select("gram", "name", "n", "lists", "spare")


def fetched_sets(docs: DataFrame, names: DataFrame, seed: int = 0) -> DataFrame:
    """``name, fragment, n, grams``: the sets of the classes (``name, id``, a table: one document of each), and of few others, by fragment, with the size of the whole."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list] = [[], [], [], [], []]
        sets = gram_sets(text_bytes(part.column("text")))
        for doc_id, name, s in zip(part.column("doc_id").to_pylist(), fingerprints(sets, seed)[0].tolist(), sets, strict=True):
            if len(s):
                cuts = np.searchsorted(s, [np.uint64((1 << 64) // FRAGMENTS * f) for f in range(1, FRAGMENTS)])
                for f, piece in enumerate(np.split(s, cuts)):
                    for column, value in zip(out, (doc_id, name, f, len(s), piece.tobytes()), strict=True):
                        column.append(value)
        if not out[0]:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "name", "fragment", "n", "grams"])

    wanted = maybe(docs.select("doc_id", "text"), "doc_id", bitmap(names.select(F.col("id").alias("doc_id")), "doc_id")).where("__maybe")
    got = map_texts(wanted.select("doc_id", "text"), work, "doc_id long, name long, fragment int, n long, grams binary")
    # Documents of one class have one set, so it may come from any of them; few others get past both bitmaps.
    got = named(got, names)
    return got.groupBy("name", "fragment").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))


def named(sets: DataFrame, classes: DataFrame, key: str = "name", count: int | None = None) -> DataFrame:
    """The sets that the classes (a table) may need: the others are left where they are, an exact join deals out the rest."""
    return maybe(sets, "name", bitmap(classes.select(F.col(key).alias("name")), "name", count)).where("__maybe").drop("__maybe")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``, a table) whose summed fragment overlaps make them similar enough."""

    def overlap(batches):
        for batch in batches:
            n = []
            one, other = batch.column("ga"), batch.column("gb")
            for i in range(batch.num_rows):
                both = np.concatenate([np.frombuffer(x[i].as_buffer(), np.uint64) for x in (one, other)])
                both.sort()
                n.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n"), pa.array(n, pa.int64())], ["a", "b", "n", "shared"])

    most = pairs.count()
    side = lambda k: named(sets, pairs, k, most).select(F.col("name").alias(k), "fragment", F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), ["a", "fragment"])
    summed = both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ga", "gb").mapInArrow(frugal(overlap), "a long, b long, n long, shared long")
    summed = summed.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("shared").alias("shared"))
    return few_tasks(summed.where(100 * F.col("shared") >= PERCENT * (F.col("n") - F.col("shared"))).select("a", "b"), most)


def labelled(members: DataFrame, labels: DataFrame | None, most: int) -> DataFrame:
    """The members (at most ``most``) of lists whose classes are of several components, with their ``label``."""
    if labels is None:
        return members.withColumn("label", F.col("name"))
    rows = members.join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    several = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    return rows.join(few_tasks(several, most), "gram")


def hub_pairs(members: DataFrame, per_list: int, per_class: int, most: int) -> DataFrame:
    """For each class its pairs (``a, b``) with the ``per_class`` hubs that it meets in most lists: of a list, the ``per_list`` classes that are in most lists.

    There are at most ``most`` members, each of which meets ``per_list`` hubs.
    """
    top = F.row_number().over(Window.partitionBy("gram").orderBy(F.desc("lists"), "name"))
    hubs = members.withColumn("__top", top).where(F.col("__top") <= per_list).select("gram", F.col("name").alias("hub"), F.col("n").alias("hn"), F.col("label").alias("hl"))
    met = few_tasks(members.join(hubs, "gram").where((F.col("label") != F.col("hl")) & similar_sizes("n", "hn")), most * per_list)
    met = few_tasks(met.groupBy("name", "hub").agg(F.count(F.lit(1)).alias("c")), most * per_list)
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("c"), "hub"))
    kept = few_tasks(met.withColumn("__best", best).where(F.col("__best") <= per_class), most * per_list)
    return kept.select(F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b")).distinct()


def similar_sizes(one: str, other: str) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * PERCENT


def sketches(sets: DataFrame) -> DataFrame:
    """``name, s0, s1, ...``: bits that each n-gram of the set turns over, so two sets differ in at least as many n-grams as their sketches in bits."""
    names = [f"s{k}" for k in range(SKETCH_WORDS)]

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, SKETCH_WORDS), np.uint64)
            for row, piece in zip(out, batch.column("grams"), strict=True):
                place = np.frombuffer(piece.as_buffer(), np.uint64) & np.uint64(64 * SKETCH_WORDS - 1)
                odd = np.bincount(place.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
                row[:] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("name"), *(pa.array(out[:, k].view(np.int64)) for k in range(SKETCH_WORDS))], ["name", *names])

    pieces = sets.select("name", "grams").mapInArrow(frugal(run), "name long, " + ", ".join(f"{s} long" for s in names))
    return pieces.groupBy("name").agg(*[F.bit_xor(s).alias(s) for s in names])  # fragments have no n-gram in common


def pairs_across(members: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (``a, b, c, one``) of different components that may be similar by their sketches and the ``c`` n-grams of lists that they share.

    ``members`` is a table. A class shares all but ``spare`` of the n-grams of its lists with whom it is similar to. It has none in common in the
    lists that are not among ``members``, which use up as many of these; so the first one that the two share,
    shortest lists first, is among the first that are left over, and one more, of either; and behind it both have enough left.
    """
    most = members.count()
    needed_sets = named(sets, members, count=most)
    spread = few_tasks(few_tasks(members.select("label", "name").distinct(), most).groupBy("label").agg(F.count(F.lit(1)).alias("classes")), most)
    length = few_tasks(members.groupBy("gram").agg(F.count(F.lit(1)).alias("length")), most)
    members = members.join(spread, "label")
    place, own = F.row_number().over(Window.partitionBy("name").orderBy("length", "gram")), Window.partitionBy("name")
    first = few_tasks(members.join(length, "gram"), most).withColumn("__place", place).withColumn("__own", F.count(F.lit(1)).over(own))
    first = first.withColumn("__spare", F.max("spare").over(own) - (F.col("lists") - F.col("__own"))).where(F.col("__place") <= F.col("__spare") + 1)
    first = first.join(sketches(needed_sets.join(members.select("name").distinct(), "name", "left_semi")), "name")
    behind, needed, component = F.col("__own") - F.col("__place") + 1, F.col("__own") - F.col("__spare"), F.struct("classes", "label")
    words = [f"s{w}" for w in range(SKETCH_WORDS)]
    first = cut(first.select("gram", "name", "n", component.alias("l"), behind.alias("behind"), needed.alias("needed"), *words))  # both sides of the join read it
    side = lambda name, k: first.select("gram", F.col("name").alias(name), *[F.col(c).alias(f"{c}{k}") for c in ("n", "l", "behind", "needed")], *[F.col(s).alias(f"{s}_{k}") for s in words])
    enough = F.least("behind1", "behind2") >= F.greatest("needed1", "needed2")
    differ = sum((F.bit_count(F.col(f"s{w}_1").bitwiseXOR(F.col(f"s{w}_2"))) for w in range(SKETCH_WORDS)), F.lit(0))
    both = F.col("n1") + F.col("n2")
    alike = (100 + PERCENT) * (both - differ) >= 2 * PERCENT * both
    found = side("one", 1).join(side("two", 2), "gram").where((F.col("l1") < F.col("l2")) & similar_sizes("n1", "n2") & enough & alike).select("one", "two", "n1", "n2").distinct()
    lists = members.groupBy("name").agg(F.collect_set("gram").alias("grams"))
    found = found.join(lists.toDF("one", "g1"), "one").join(lists.toDF("two", "g2"), "two")
    found = found.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), F.size(F.array_intersect("g1", "g2")).alias("long"), "one", "n1", "n2")
    found = found.join(pairs, ["a", "b"], "left").withColumn("c", F.col("long") + F.coalesce("c", F.lit(0)))
    return found.where(may_be_similar(F.col("c"), F.col("n1"), F.col("n2"))).select("a", "b", "c", "one")


def of_several(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are of different components."""
    la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def joined_links(links: DataFrame, more: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with those found since, and the components; these are looked for only where a link joins two."""
    if of_several(more, labels).isEmpty():
        return links, labels
    links = links.union(more)
    return links, components(links)


def similar_classes(docs: DataFrame, sizes: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """``node, label``: the components of the classes that are linked with another class."""
    order = common_order(docs, total, seed)
    found = cut(pairs_and_members(postings(docs, order, seed), order))
    most = found.count()
    pairs = cut(few_tasks(found.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c")), most))
    members = found.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("name"), F.col("c").alias("n"))
    highest = pairs.select(F.explode(F.array("a", "b")).alias("name"), "c").groupBy("name").agg(F.max("c").alias("c"))
    weights = members.groupBy("name").agg(F.count(F.lit(1)).alias("lists")).join(highest, "name", "left")
    weights = cut(few_tasks(weights.select("name", "lists", (F.col("lists") + F.coalesce("c", F.lit(0))).alias("shared")), most))
    members = cut(few_tasks(open_to_links(members, weights, most), most))
    listed = members.count()
    hubs = hub_pairs(labelled(members, None, listed), 1, 1, listed).join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0)).alias("c"))
    tested = cut(few_tasks(possible(pairs.select("a", "b", "c").union(hubs), sizes, weights).select("a", "b").distinct(), most + listed))
    names = tested.select(F.explode(F.array("a", "b")).alias("name")).union(members.select("name")).distinct()
    sets = cut(fetched_sets(docs, cut(names.join(sizes.select("name", "id"), "name")), seed))
    links = cut(verified(tested, sets))
    labels = components(links)
    # Those that are not linked with the first hub of a list may be with others.
    left = labelled(members, labels, listed)
    if left.isEmpty():
        return labels
    fresh = cut(few_tasks(hub_pairs(left, *MORE_HUBS, listed).join(tested, ["a", "b"], "left_anti"), listed * MORE_HUBS[1]))
    tested, more = tested.union(fresh), cut(verified(fresh, sets))
    links, labels = joined_links(links, more, labels)
    left = cut(few_tasks(labelled(members, labels, listed), listed))
    if left.isEmpty():
        return labels
    # What is left: pairs of different components. First those that share most, then whatever is still needed.
    place = F.row_number().over(Window.partitionBy("one").orderBy(F.desc("c"), "a", "b"))
    rest = cut(pairs_across(left, pairs, sets).join(tested, ["a", "b"], "left_anti").withColumn("place", place))
    if rest.isEmpty():
        return labels
    links, labels = joined_links(links, cut(verified(rest.where(F.col("place") <= FIRST_PAIRS), sets)), labels)
    rest = cut(of_several(rest.where(F.col("place") > FIRST_PAIRS).select("a", "b"), labels))
    if rest.isEmpty():
        return labels
    return joined_links(links, cut(verified(rest, sets)), labels)[1]


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row of ``docs``.

    A null, empty or blank text has no n-grams and is linked with nothing; equal sets are linked, repeated
    rows too. A null id takes part in links but is never the smallest of a component unless alone. An empty
    table gives no rows; other columns of ``docs`` play no part.
    """
    for seed in range(9):
        scanned = cut(scan(docs, seed))
        sizes = cut(scanned.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.min("other").alias("low"), F.max("other").alias("high")))
        if sizes.where("low <> high").isEmpty():  # else two sets have one name: others are given
            break
    total = scanned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = scanned.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "name")
    labels = similar_classes(docs, sizes, total, seed).select(F.col("node").alias("name"), "label")
    rows = rows.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "label", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
