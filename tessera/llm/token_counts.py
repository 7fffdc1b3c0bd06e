"""Token counts with a subword model; huge documents by overlap resynchronisation.

A boundary between two characters is *proven stable* when no piece of the vocabulary holds the two side
by side: no merge can ever cross it, so what stands left and right is encoded independently. Ordinary
texts are cut at such boundaries before words and each distinct part is encoded once per worker. A huge
text is encoded in overlapping chunks with offsets; two neighbouring chunks are spliced at the first
proven stable boundary, inside their overlap, at which both have a token boundary; where there is none
the overlap is doubled until there is, or the text ends.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

SPACE = "▁"
#: Characters of a chunk of a huge text, its first overlap, and the memo's size in parts.
CHUNK, OVERLAP, MEMO = 65536, 256, 600_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts tokens as the library does, without special tokens."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Whether a space after another character is always stable, so that words are independent.
        self.words_stable = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.pairs)
        self.memo: dict[str, int] = {SPACE: 1}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1] not in self.pairs

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
        out = [0] * len(texts)
        if self.words_stable:
            # Each part is a run of spaces with what follows it, as the model sees it after its own prefix.
            parts = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + texts[i].replace(" ", SPACE)) if texts[i] else [] for i in short]
            fresh = list({p for ps in parts for p in ps} - self.memo.keys())
            if len(self.memo) + len(fresh) > MEMO:
                self.memo = {SPACE: 1}
                fresh = list({p for ps in parts for p in ps} - {SPACE})
            self.memo.update(zip(fresh, map(len, self.model.encode([p[1:] for p in fresh], num_threads=1)), strict=True))
            memo = self.memo
            for i, ps in zip(short, parts, strict=True):
                out[i] = sum(map(memo.__getitem__, ps))
        else:
            for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
                out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > CHUNK:
                out[i] = self.count_long(t)
        return out

    def boundaries(self, seen: str, start: int, stop: int) -> np.ndarray:
        """Where the tokens of ``seen[start:stop]`` begin, as places in ``seen``; one entry a token."""
        # The chunk's own first space is what the model's prefix stands for; elsewhere the prefix is a token or part of one in front.
        own = seen[start] == SPACE
        chunk = seen[start + own : stop].replace(SPACE, " ")
        shift = start + own
        begins = np.asarray([p.begin for p in self.model.encode(chunk, return_type="proto").pieces], dtype=np.int64)
        if len(begins) and not chunk.isascii():  # the library gives places in bytes
            codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
            begins = np.searchsorted(ends, begins, side="right")
        return begins + shift - (begins == 0) * own

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The tokens of a text of any length, from overlapping chunks."""
        seen = SPACE + text.replace(" ", SPACE)
        n, start, left, total = len(seen), 0, 0, 0
        while True:
            # Tokens before ``left`` are counted; the chunk starts at ``start`` <= left.
            stop, wide = min(n, left + chunk), overlap
            here = self.boundaries(seen, start, min(n, stop + wide))
            if stop >= n:
                return total + int((here >= left).sum())
            while True:
                end = min(n, stop + wide)
                following = self.boundaries(seen, stop, min(n, end + chunk))
                both = np.intersect1d(here, following)
                at = next((int(b) for b in both if stop < b < end and self.stable(seen, int(b))), None)
                if at is not None or end >= n:
                    break
                wide *= 2
                here = self.boundaries(seen, start, min(n, stop + wide))
            if at is None:
                return total + int((here >= left).sum())
            total += int(((here >= left) & (here < at)).sum())
            start, left = stop, at


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    A null or empty text has no bytes and no tokens. Rows, repeated ones too, give one row each.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column("text").to_pylist()]
        n = np.asarray(counter(model_file).counts(texts), dtype=np.int64)
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)
