"""Best-fit packing of tokenised documents into sequences: best-two-fit.

Pieces are dealt into groups of bounded size, and a group is packed on its own, so a group costs at most one
sequence that is not full. In a group a sequence is filled greedily with the longest piece that still fits.
When nothing fits its gap, its smallest piece is taken out again and the two unpacked pieces that fill the
expanded gap most tightly replace it, if they fill it better.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tessera.llm.common import cut, frugal, slices, text_bytes

CAPACITY, GROUP_PIECES, MEMO = 2048, 8192, 200_000
#: Bytes of text that are encoded at once.
ENCODED_BYTES = 1 << 19
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


#: Classes of bytes: white space, letters, digits, other marks, and what only the tokenizer itself cuts.
WHITE, LETTER, DIGIT, MARK, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = MARK
CLASS[[32, *range(9, 14)]] = WHITE
CLASS[48:58] = DIGIT
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For the letters from U+00C0 to U+017F, by their two bytes: the lower-case one's, or 0 where only the tokenizer knows.
LEADS = (0xC3, 0xC4, 0xC5)


def _two_byte_letters() -> np.ndarray:
    out = np.zeros((len(LEADS), 64, 2), np.uint8)
    for i, lead in enumerate(LEADS):
        for trail in range(64):
            one = bytes([lead, 0x80 + trail]).decode()
            low = one.lower()
            if unicodedata.category(one)[0] == "L" and len(low) == 1 and len(low.encode()) == 2 and unicodedata.is_normalized("NFC", one):
                out[i, trail] = list(low.encode())
    return out


TWO_BYTES = _two_byte_letters()
#: The tokenizer's contractions: an apostrophe that begins a run of marks, and these letters.
SHORT_ENDS, LONG_ENDS = b"stmd", (b"re", b"ve", b"ll")
#: Parts of up to this many bytes stand for themselves as two numbers.
NARROW = 16
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for a byte: the printable ones of Latin-1 as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)} | {32: " "}


BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Ids by parts of words: the tokenizer drops white space and looks at nothing across it, so words are independent.

    Words are cut further where that is certain to be the tokenizer's own cut: into runs of letters, single digits,
    runs of other marks and contractions. Each distinct part, lower-cased, goes through the tokenizer once; the ids
    of a slice are gathered with numpy. A word with other bytes than ASCII and Latin letters, or with the
    beginning of a special string, goes through the tokenizer whole.
    """

    def __init__(self, file: str):
        # The same merges without the steps that whole texts need, for parts that are cut and in lower case already.
        # A task has one core; more threads would also each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.file, self.merges = file, Tokenizer.from_file(file)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, end = self.merges.get_vocab(), self.merges.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(end)
        self.forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.file)

    def forget(self) -> None:
        self.key, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))  # parts by their key, ascending
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # their ids in ``ids``
        self.ids = np.zeros(1, np.uint32)  # the first is the id 0 that ends a text
        self.wide: dict[bytes, tuple[int, int]] = {}

    def learn(self, parts: list[bytes], cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some parts are, and how many; ``cut``: they are the tokenizer's own parts in lower case."""
        if cut:
            rows = [b" ".join(parts[i : i + 100]).decode("latin-1").translate(BYTE_LETTERS) for i in range(0, len(parts), 100)]
            found = []
            for i in range(0, len(rows), 50):
                found += [np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(rows[i : i + 50], add_special_tokens=False)]
            ids = np.concatenate([np.zeros(0, np.uint32), *found])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(parts):
                count = np.diff(last, prepend=-1)
                first = len(self.ids) + np.cumsum(count) - count
                self.ids = np.concatenate([self.ids, ids])
                return first, count
        found = []
        for i in range(0, len(parts), 5000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts[i : i + 5000]], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))])
        return first, count

    @staticmethod
    def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that end with line feeds: the bytes in lower case, where parts begin and end, and which are for the tokenizer alone."""
        kind, data = CLASS[data], data.copy()
        leads = np.flatnonzero((data >= LEADS[0]) & (data <= LEADS[-1]))
        if len(leads):
            low = TWO_BYTES[data[leads] - LEADS[0], data[leads + 1] - 0x80]
            known = low[:, 0] > 0
            leads, low = leads[known], low[known]
            data[leads], data[leads + 1] = low[:, 0], low[:, 1]
            kind[leads] = kind[leads + 1] = LETTER
        original, data = data, LOWER[data]
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        kind[special] = ODD
        white = kind == WHITE
        begin = np.r_[True, white[:-1]] & ~white
        word = np.cumsum(begin) - 1
        odd_word = np.zeros(int(word[-1]) + 2, bool)  # the last is for white space before any word
        odd_word[word[kind == ODD]] = True
        before = np.r_[np.uint8(WHITE), kind[:-1]]
        start = (kind != before) | (kind == DIGIT)
        mark = np.flatnonzero((data == ord("'")) & (before != MARK))
        ahead = np.r_[data, np.uint8(10), np.uint8(10)]
        one, two = ahead[mark + 1], ahead[mark + 2]
        short = np.isin(one, np.frombuffer(SHORT_ENDS, np.uint8))
        long = np.zeros(len(mark), bool)
        for end in LONG_ENDS:
            long |= (one == end[0]) & (two == end[1])
        for at, size in ((mark[short], 2), (mark[long], 3)):
            for k in range(1, size):
                start[at + k] = False
            start[at + size] = True
        odd = odd_word[word] & ~white
        start = np.where(odd, begin, start & ~white)
        begin = np.flatnonzero(start)
        # A part ends where the next begins or white space does.
        stop = np.flatnonzero(start | (white & ~np.r_[True, white[:-1]]))
        stop = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else stop[:0]
        alone = odd[begin]
        if alone.any():  # the tokenizer sees these as they were written
            inside = np.flatnonzero(odd)
            data[inside] = original[inside]
        return data, begin, stop, alone

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, with an id 0 at the end."""
        if not texts:
            return []
        raw = b"\n".join(texts) + b"\n"
        data, begin, stop, alone = self.cut(np.frombuffer(raw, np.uint8))
        size = stop - begin
        whole = np.concatenate([data, np.zeros(NARROW, np.uint8)])
        eight = np.ndarray(len(data) + 8, "<u8", whole.data, strides=(1,))
        low = eight[begin] & _MASKS[np.minimum(size, 8)]
        high = eight[begin + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]
        first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        if len(self.key) + len(self.wide) > MEMO:
            self.forget()
        narrow = np.flatnonzero((size <= NARROW) & ~alone)
        if len(narrow):
            key = part_keys(low[narrow], high[narrow])
            fresh, at, back = np.unique(key, return_index=True, return_inverse=True)
            at = narrow[at]
            if (low[at][back] != low[narrow]).any() or (high[at][back] != high[narrow]).any():
                alone = np.ones(len(begin), bool)  # two parts with one key: none goes by its key
            else:
                place = np.minimum(np.searchsorted(self.key, fresh), max(0, len(self.key) - 1))
                known = self.key[place] == fresh if len(self.key) else np.zeros(len(fresh), bool)
                if ((self.low[place[known]] != low[at[known]]) | (self.high[place[known]] != high[at[known]])).any():
                    alone = np.ones(len(begin), bool)
                else:
                    new = at[~known]
                    if len(new):
                        lowered = whole.tobytes()
                        where, many = self.learn([lowered[a:b] for a, b in zip(begin[new].tolist(), stop[new].tolist(), strict=True)], True)
                        columns = zip((self.key, self.low, self.high, self.first, self.count), (fresh[~known], low[new], high[new], where, many), strict=True)
                        columns = [np.concatenate(c) for c in columns]
                        by = np.argsort(columns[0])
                        self.key, self.low, self.high, self.first, self.count = (c[by] for c in columns)
                    place = np.searchsorted(self.key, fresh)[back]
                    first[narrow], count[narrow] = self.first[place], self.count[place]
        other = np.flatnonzero((size > NARROW) | alone)
        if len(other):
            lowered = whole.tobytes()
            parts = [lowered[a:b] for a, b in zip(begin[other].tolist(), stop[other].tolist(), strict=True)]
            for cut in (True, False):  # long parts, and words for the tokenizer alone
                wanted = {p for p, whole_word in zip(parts, alone[other].tolist(), strict=True) if whole_word != cut}
                if fresh := list(wanted - self.wide.keys()):
                    for p, a, n in zip(fresh, *(x.tolist() for x in self.learn(fresh, cut)), strict=True):
                        self.wide[p] = (a, n)
            found = np.array([self.wide[p] for p in parts], np.int64)
            first[other], count[other] = found[:, 0], found[:, 1]
        # An id 0 after the parts of each text.
        ends = np.cumsum([len(t) + 1 for t in texts])
        after = np.searchsorted(begin, ends)
        first, count = np.insert(first, after, 0), np.insert(count, after, 1)
        total = np.cumsum(count)
        ids = self.ids[np.repeat(first - total + count, count) + np.arange(int(total[-1]))]
        return np.split(ids, total[after + np.arange(len(texts))][:-1])


def part_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One number for the two that a part is; a coincidence is found and costs time only."""
    x = (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids, cut into pieces of ``capacity`` where there are more."""

    def pieces_of(part: pa.RecordBatch, encoder: WordEncoder) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(text_bytes(part.column("text"))), strict=True):
            for number, start in enumerate(range(0, len(ids), capacity)):
                own = ids[start : start + capacity]
                for column, value in zip(out, (doc_id, number, start, len(own), zlib.crc32(own.tobytes())), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches):
        encoder = None  # one a task, so that idle workers hold none
        for part in slices(batches, size=ENCODED_BYTES):
            encoder = encoder or WordEncoder(tokenizer_file)
            yield pieces_of(part, encoder)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), PIECE_SCHEMA)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1]:
        stock[lengths[i]].append(int(i))
    size = np.arange(capacity + 1)
    have = np.array([len(s) > 0 for s in stock])
    fits = np.maximum.accumulate(np.where(have, size, 0))  # the longest piece in stock up to each length

    def take(length: int) -> int:
        i = stock[length].pop()
        if not stock[length]:
            have[length] = False
            end = np.searchsorted(fits, length, side="right")
            fits[length:end] = fits[length - 1]
        return i

    def put(i: int) -> None:
        length = int(lengths[i])
        stock[length].append(i)
        if not have[length]:
            have[length] = True
            np.maximum(fits[length:], length, out=fits[length:])

    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while fits[capacity]:
        gap, bin_ = capacity, []
        while gap and fits[gap]:
            i = take(int(fits[gap]))
            bin_.append(i)
            gap -= int(lengths[i])
        if gap and len(bin_) > 1 or gap and bin_ and lengths[bin_[-1]] > 1:
            smallest = min(bin_, key=lambda i: lengths[i])
            wide = gap + int(lengths[smallest])
            first = np.flatnonzero(have[: wide + 1])
            if len(first):
                second = fits[wide - first]
                # Two of one length need two in stock.
                twice = (second == first) & np.array([len(stock[a]) < 2 for a in first])
                if twice.any():
                    below = np.array([fits[a - 1] if a > 1 else 0 for a in first])
                    second = np.where(twice, below, second)
                both = np.where(second > 0, first + second, 0)
                k = int(both.argmax())
                if both[k] > lengths[smallest]:
                    bin_.remove(smallest)
                    bin_ += [take(int(first[k])), take(int(second[k]))]
                    put(smallest)
        at = 0
        for i in bin_:
            sequence[i], offset[i] = number, at
            at += int(lengths[i])
        number += 1
    return sequence, offset


def pack(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``rows`` (``n_rows`` pieces) with ``sequence_id`` and ``offset``; groups by a hash of the document and piece."""
    groups = max(1, -(-n_rows // group_pieces))

    def work(group: pa.Table) -> pa.Table:
        # Arrow keeps ids whole beside null ones, which pandas would turn to doubles.
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=order))
        sequence, offset = best_two_fit(group["length"].to_numpy(), capacity)
        number = np.int64(group["grp"][0].as_py()) << np.int64(32)
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(number + sequence)).append_column("offset", pa.array(offset))

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInArrow(work, SCHEMA)


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document, and its place.

    A null or empty text is the single id 0. Repeated rows are packed each on their own; an empty table
    gives no rows; a null id is kept. The pieces are written to the shared folder first: they are counted, and
    a lost executor costs no second encoding.
    """
    rows = cut(pieces(docs, tokenizer_file, capacity))
    return pack(rows, rows.count(), capacity)
