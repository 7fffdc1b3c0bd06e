"""How two tokenizers cut the same text, and which of their tokens go together; a cogroup of postings.

Texts are encoded in parts that neither tokenizer can merge across, each distinct part once a worker. A lot of texts
becomes posting lists: for every id pair that some text links, the texts and how often. These are dealt by the id of
the first side (a bucket of ids) and, as frequent ids are in all texts, by their lot. Beside them, in the same sorted
stream and first in it, comes what the corpus counts for the bucket's pairs. A task holds those counts, finds each
id's maximum, and lets the posting lists pass by: each gives what its texts have of it, which is summed by text.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import cut, frugal, slices

SPACE = "▁"
#: A part begins with white space behind something else, where that is a space or a line break.
PARTS, AT_SPACES = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*"), re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: Bits of an id, bytes of text of a lot, bytes of parts that a worker remembers.
ID_BITS, LOT_BYTES, MEMO_BYTES = 20, 4 << 20, 64 << 20
#: Links of a group up to which all are written out before equal ones are counted; buckets of ids; pairs in a row of counts.
GROUP_LINKS, BUCKETS, COUNT_ROWS = 1024, 16, 1 << 18
ID_MASK = (1 << ID_BITS) - 1
ENCODED = "lot long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, pairs binary, sizes binary, places binary, times binary"
FOUND = "lot long, place int, n_best long, count_sum long"
STREAM = "bucket int, kind int, lot long, pairs binary, sizes binary, places binary, times binary"


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative whole numbers as bytes: by place value, so that what is always zero costs nothing."""
    width = 8 if len(values) and int(values.max()) >= 1 << 32 else 4
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and what is known of the parts seen so far."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        values, size = byte_values(), self.first.get_vocab_size()
        self.bytes_a = [bytes(values[c] for c in w) if (w := self.first.id_to_token(i) or "") and all(c in values for c in w) else w.encode() for i in range(size)]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if max(size, len(pieces)) > ID_MASK:
            raise ValueError(f"ids beyond {ID_MASK} do not fit")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.bytes_a, self.bytes_b))
        #: Every id as it is written, with what can follow: of the first side "," and "|", of the second ",", ";" and the end of a part.
        self.written_ids = [f"{i}{end}" for n, ends in ((size, ",|"), (len(pieces), ",;\0")) for end in ends for i in range(n)]
        self.space = self.second.piece_to_id(SPACE)
        # Parts are independent for the second tokenizer if no piece holds a space, or a line break, behind or before something else.
        whole = [p for i, p in enumerate(pieces) if not (self.second.is_byte(i) or self.second.is_control(i) or self.second.is_unknown(i))]
        self.spaces_apart = not any(SPACE in p.lstrip(SPACE) for p in whole)
        self.breaks_apart = self.spaces_apart and not any("\n" in p for p in whole)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.known = 0
        self.texts: list[bytes] = []
        self.numbers = np.zeros((0, 5), dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)
        self.pairs = self.times = np.zeros(0, dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        return (PARTS if self.breaks_apart else AT_SPACES).findall(" " + text) if self.spaces_apart else [" " + text]

    def pieces(self, parts: list[str]) -> list[list[int]]:
        """The second tokenizer's ids of each part, without the space that it puts in front of a line break."""
        out = self.second.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [[self.space] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(parts, out, strict=True)]

    def learn(self, parts: list[str]) -> None:
        """Tokens, groups and links of new parts."""
        encode = getattr(self.first, "encode_batch_fast", self.first.encode_batch)
        a = [e.ids for e in encode(parts, add_special_tokens=False)]
        b = self.pieces(parts)
        right = self.given_back(parts, a, b)
        a, b = ([x if ok else [] for x, ok in zip(ids, right, strict=True)] for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (a, b))
        ends_a, ends_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        both = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        part_a = np.repeat(np.arange(len(parts)), [len(x) for x in a])
        part_of = np.zeros(len(both), dtype=np.int64)
        part_of[group_a] = part_a
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        links = in_a * in_b
        count = lambda of, weights=None: np.bincount(of, weights, minlength=len(parts)).astype(np.int64)
        numbers = np.stack([right, [len(x) for x in a], [len(x) for x in b], count(part_of), count(part_of, links)], axis=1).astype(np.int64)
        texts = self.written(flat_a, flat_b, group_a, group_b, part_of)
        self.texts += [next(texts) if n else b"" for n in numbers[:, 3].tolist()]
        keys, times, of = self.linked(flat_a, flat_b, in_a, in_b, part_of)
        order = np.lexsort((keys, of))
        keys, times, of = keys[order], times[order], of[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.pairs, self.times = np.concatenate([self.pairs, keys[new]]), np.concatenate([self.times, np.add.reduceat(times, new) if len(new) else times])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(of[new], minlength=len(parts)))])
        self.numbers = np.concatenate([self.numbers, numbers])
        self.memo.update(zip(parts, range(len(self.memo), len(self.memo) + len(parts)), strict=True))
        self.known += sum(map(len, parts)) + sum(map(len, self.texts[len(self.texts) - len(parts) :])) + 100 * len(parts) + 16 * len(new)

    def given_back(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Which parts both tokenizers give back byte by byte."""
        sources = [p.encode() for p in parts]
        sizes = np.array([len(x) for x in sources])
        right = np.ones(len(parts), dtype=bool)
        for ids, known, each in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b)):
            flat = list(chain.from_iterable(ids))
            of = np.repeat(np.arange(len(parts)), [len(x) for x in ids])
            same = np.bincount(of, each[np.array(flat, dtype=np.int64)], minlength=len(parts)) == sizes
            if not same.all() or b"".join(map(known.__getitem__, flat)) != b"".join(sources):
                same = np.array([b"".join(map(known.__getitem__, x)) == source for x, source in zip(ids, sources, strict=True)], dtype=bool)
            right &= same
        return right

    def written(self, flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, part_of: np.ndarray) -> Iterator[bytes]:
        """The groups of each part that has any, as text."""
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        closes = np.r_[part_of[1:] != part_of[:-1], True]
        if not len(part_of):
            return iter(())
        size, pieces = len(self.bytes_a), len(self.bytes_b)
        which = np.concatenate([flat_a + size * last_a, 2 * size + flat_b + pieces * (last_b * (1 + closes[group_b]))])
        order = np.lexsort((np.r_[np.zeros(len(flat_a)), np.ones(len(flat_b))], np.concatenate([group_a, group_b])))
        return iter("".join(map(self.written_ids.__getitem__, which[order].tolist())).encode().split(b"\0"))

    @staticmethod
    def linked(flat_a: np.ndarray, flat_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, part_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All linked id pairs as one number each, how often, and the part; of a large group equal ids are counted first."""
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        small = in_a * in_b <= GROUP_LINKS
        n = (in_a * in_b)[small]
        group = np.repeat(np.flatnonzero(small), n)
        within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        x, y = flat_a[from_a[group] + within // in_b[group]], flat_b[from_b[group] + within % in_b[group]]
        found = [((x << ID_BITS) | y, np.ones(len(x), dtype=np.int64), part_of[group])]
        for g in np.flatnonzero(~small):
            ids_a, times_a = np.unique(flat_a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            ids_b, times_b = np.unique(flat_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            keys = ((ids_a[:, None] << ID_BITS) | ids_b).ravel()
            found.append((keys, np.outer(times_a, times_b).ravel(), np.full(len(keys), part_of[g])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def lot(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and digest of every text; its links as pair, place of the text and times, each once."""
        if self.known > MEMO_BYTES:
            self.forget()
        split = [self.parts(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for ps in split for p in ps if p not in self.memo))
        for i in range(0, len(fresh), 20_000):
            self.learn(fresh[i : i + 20_000])
        memo, known = self.memo, self.texts
        seen = [list(map(memo.__getitem__, ps)) for ps in split]
        lengths = np.array([len(s) for s in seen], dtype=np.int64)
        flat = np.fromiter((i for s in seen for i in s), dtype=np.int64, count=int(lengths.sum()))
        place = np.repeat(np.arange(len(texts)), lengths)
        numbers = np.stack([np.bincount(place, self.numbers[flat, k], minlength=len(texts)) for k in range(5)], axis=1).astype(np.int64)
        right = (numbers[:, 0] == lengths) & (lengths > 0)
        numbers[~right] = 0
        digests = [hashlib.sha256(b";".join(map(known.__getitem__, s))).hexdigest() if ok else "" for s, ok in zip(seen, right, strict=True)]
        keep = right[place]
        once, often = np.unique((place[keep] * len(known)) + flat[keep], return_counts=True)
        place, part = once // max(len(known), 1), once % max(len(known), 1)
        n = self.starts[part + 1] - self.starts[part]
        entry = np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return numbers[:, 1:], digests, self.pairs[entry], np.repeat(place, n), self.times[entry] * np.repeat(often, n)


@lru_cache(maxsize=1)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def joined(pairs: np.ndarray, place: np.ndarray, times: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Posting lists by bucket of the first id: pairs in order, how many texts each has, these in order, and times."""
    order = np.lexsort((place, pairs, (pairs >> ID_BITS) % buckets))
    pairs, place, times = pairs[order], place[order], times[order]
    if not len(pairs):
        return
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (place[1:] != place[:-1])])
    pairs, place, times = pairs[first], place[first], np.add.reduceat(times, first)
    bucket = (pairs >> ID_BITS) % buckets
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        p = pairs[start:stop]
        begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        yield int(bucket[start]), p[begin], np.diff(np.r_[begin, len(p)]), place[start:stop], times[start:stop]


def encoded(docs: DataFrame, byte_file: str, piece_file: str, buckets: int) -> DataFrame:
    """One row a text with its numbers, and one a lot and bucket with posting lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches, size=LOT_BYTES)):
            lot, n = task + number, part.num_rows
            numbers, digests, *links = aligner(byte_file, piece_file).lot([t or "" for t in part.column("text").to_pylist()])
            none = pa.nulls(n, pa.binary())
            columns = [pa.array(np.full(n, lot)), pa.array(np.arange(n, dtype=np.int32)), part.column("doc_id").cast(pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), none, none, none, none], names(ENCODED))
            lists = [(bucket, *map(squeezed, arrays)) for bucket, *arrays in joined(*links, buckets)]
            if lists:
                m = len(lists)
                empty = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, lot)), *empty, *(pa.array(c, k) for c, k in zip(zip(*lists, strict=True), kinds, strict=True))], names(ENCODED))

    return docs.select("doc_id", "text").mapInArrow(frugal(run), ENCODED)


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def pair_counts(lists: DataFrame) -> DataFrame:
    """``pair, count``: how many texts link an id pair. A task adds up what it sees before anything is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sizes = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for p, s in zip(batch.column("pairs").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                pairs, sizes = np.concatenate([pairs, unsqueezed(p)]), np.concatenate([sizes, unsqueezed(s)])
                if len(pairs) > 4 * COUNT_ROWS:
                    pairs, sizes = added(pairs, sizes)
                    if len(pairs) > 2 * COUNT_ROWS:
                        yield rows(pairs, sizes)
                        pairs = sizes = np.zeros(0, dtype=np.int64)
        if len(pairs):
            yield rows(*added(pairs, sizes))

    def rows(pairs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sizes)], ["pair", "count"])

    return lists.select("pairs", "sizes").mapInArrow(frugal(run), "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def added(pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its sizes."""
    order = np.argsort(pairs, kind="stable")
    pairs, sizes = pairs[order], sizes[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, dtype=np.int64)
    return pairs[first], np.add.reduceat(sizes, first) if len(first) else sizes


def count_blobs(counts: DataFrame, buckets: int) -> DataFrame:
    """Counts as rows of ``COUNT_ROWS`` pairs at most, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count"))
            bucket = (pairs >> ID_BITS) % buckets
            for b in np.unique(bucket).tolist():
                p, s = pairs[bucket == b], sizes[bucket == b]
                order = np.argsort(p)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([squeezed(p[order])], pa.binary()), pa.array([squeezed(s[order])], pa.binary())], ["bucket", "pairs", "sizes"])

    return counts.mapInArrow(frugal(run), "bucket int, pairs binary, sizes binary")


def contributions(stream: DataFrame) -> DataFrame:
    """What the texts have of the bucket's pairs, from a stream sorted by bucket with its counts (kind 0) in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces, table = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, kind, lot, *data = (batch.column(c)[row].as_py() for c in names(STREAM))
                if bucket != held:
                    held, pieces, table = bucket, [], None
                if kind == 0:
                    pieces.append((unsqueezed(data[0]), unsqueezed(data[1])))
                    continue
                if table is None:
                    pairs, counts = added(*(np.concatenate(x) for x in zip(*pieces, strict=True)))
                    pieces, side = [], pairs >> ID_BITS
                    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
                    most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(side)]))
                    table = pairs, counts, counts == most
                yield of_texts(lot, table, *map(unsqueezed, data))

    def of_texts(lot: int, table: tuple, pairs: np.ndarray, sizes: np.ndarray, places: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        at = np.repeat(np.searchsorted(table[0], pairs), sizes)
        n = int(places.max()) + 1
        best, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.add.at(best, places, times * table[2][at])
        np.add.at(total, places, times * table[1][at])
        there = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), lot)), pa.array(there.astype(np.int32)), pa.array(best[there]), pa.array(total[there])], names(FOUND))

    return stream.select(*names(STREAM)).mapInArrow(frugal(run), FOUND)


def aligned(docs: DataFrame, byte_file: str, piece_file: str, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens: zeros and an
    empty digest; it counts nowhere. Rows are texts of their own, repeated ones too, and null ids are ids like others.
    Very long texts are lots of their own; a part without white space is encoded as a whole. A worker holds a lot and
    the counts of a bucket: ``buckets`` bounds these (at most all id pairs of a bucket's ids). An empty table gives no rows.
    """
    table = cut(encoded(docs, byte_file, piece_file, buckets))
    lists = table.where(F.col("bucket").isNotNull())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, math.ceil(2 * tasks / buckets))
    deal = lambda bucket, part: F.col(bucket) * parts + part
    counts = count_blobs(pair_counts(lists), buckets).select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("lot"), "pairs", "sizes", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("times"))
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    postings = lists.select("bucket", F.lit(1).alias("kind"), "lot", "pairs", "sizes", "places", "times", F.pmod(F.hash("lot"), F.lit(parts)).alias("part"))
    dealt = counts.unionByName(postings).withColumn("deal", deal("bucket", F.col("part"))).repartitionById(tasks, F.pmod("deal", F.lit(tasks)).cast("int"))
    # Buckets and parts of a task one after the other, the counts in front of the postings.
    found = contributions(dealt.sortWithinPartitions("deal", "kind").select(F.col("deal").alias("bucket"), *names(STREAM)[1:]))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    texts = table.where(F.col("bucket").isNull()).select("lot", "place", "doc_id", *numbers, "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    merged = texts.unionByName(found, allowMissingColumns=True).groupBy("lot", "place")
    sums = merged.agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in numbers), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return sums.drop("lot", "place")
