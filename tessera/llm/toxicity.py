"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a run of letters, digits and bytes from 128 on, lower-cased; its subwords are the byte n-grams of
3 to 7 of the word with a mark on either side. The mean of a word's subword vectors is its vector; the mean
over a segment of 8 words (a shorter one is filled up with zero vectors) goes through a linear softmax.
Embeddings and softmax are trained jointly on segments; of a toxic document those segments count as toxic
that the model finds so, and the most toxic one. The vectors start from how much likelier toxic documents
have a subword. A document's probability is a logistic function of its most toxic segments of three sizes
and of its mean, so that a few insults in a long text are not averaged away; it is fitted on sample
documents that the embeddings were not, weighted to the class shares of all training labels.

With two classes the softmax depends on the difference of its two rows only, and averages are linear, so a
subword's vector acts through one number; scoring looks these numbers up, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, joined_bytes, map_texts, small_table, text_bytes
from tessera.llm.folds import class_totals, fold, labelled_sample

BITS, DIMENSIONS, SEGMENT, GRAMS = 18, 8, 8, (3, 4, 5, 6, 7)
#: Words of the segments whose most toxic one a document's logit goes by, besides its mean.
VIEWS = (1, 8, 64)
#: Bounds of the training sample: documents of class 0 and 1, and bytes of their texts together.
PER_CLASS, SAMPLE_BYTES = (3000, 1500), 8 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_byte = np.arange(256)
#: 0 for what separates words, else the lower-cased byte.
FOLDED = np.where((_byte >= 128) | np.isin(_byte, [*range(48, 58), *range(97, 123)]), _byte, np.where((_byte >= 65) & (_byte <= 90), _byte + 32, 0)).astype(np.uint8)


class Subwords(NamedTuple):
    """Some texts, folded, and where their words, segments and texts begin."""

    data: np.ndarray
    words: np.ndarray
    word_segment: np.ndarray
    segment_text: np.ndarray
    texts: int

    def by_size(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n of the n-grams, one after the other: each place's bucket, and whether an n-gram begins there."""
        n = len(self.data) - max(GRAMS)
        wide = self.data.astype(np.uint32)
        hashed, inner = wide[:n].copy(), np.ones(n, bool)
        for size in range(2, max(GRAMS) + 1):
            hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x01000193) + wide[size - 1 : n + size - 1]
            if size > 2:
                inner = inner & (self.data[size - 2 : n + size - 2] != 0)
            if size in GRAMS:
                yield (((hashed ^ np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32), inner


def subwords(texts: list[bytes]) -> Subwords:
    data, starts = joined_bytes([b" " + t + b" " for t in texts])
    data = np.concatenate([FOLDED[data], np.zeros(max(GRAMS), np.uint8)])
    n = len(data) - max(GRAMS)
    is_word = data[:n] != 0
    words = np.flatnonzero(is_word[1:] & ~is_word[:-1])  # the mark before each word
    text = np.searchsorted(starts, words, side="right") - 1
    first = np.searchsorted(words, starts[:-1])
    block = (np.arange(len(words)) - first[text]) // SEGMENT
    fresh = np.ones(len(words), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1])
    return Subwords(data, words, np.cumsum(fresh) - 1, text[fresh], len(texts))


def views(s: Subwords, weights: np.ndarray) -> np.ndarray:
    """For each text: its most toxic segment of each size in ``VIEWS``, and the mean over its words."""
    out = np.zeros((s.texts, len(VIEWS) + 1))
    if not len(s.words):
        return out
    total = np.zeros(len(s.data) - max(GRAMS), np.float32)
    count = np.zeros(len(total), np.uint8)
    for buckets, valid in s.by_size():
        total += np.where(valid, weights[buckets], np.float32(0))
        count += valid
    each = np.add.reduceat(total, s.words) / np.maximum(np.add.reduceat(count, s.words, dtype=np.int32), 1)
    text = s.segment_text[s.word_segment]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    number = np.arange(len(text)) - np.repeat(first, np.diff(np.r_[first, len(text)]))
    has = text[first]
    for k, words in enumerate(VIEWS):
        cuts = np.flatnonzero(number % words == 0)
        means = np.add.reduceat(each, cuts) / words
        out[has, k] = np.maximum.reduceat(means, np.searchsorted(cuts, first))
    out[has, -1] = np.add.reduceat(each, first) / np.diff(np.r_[first, len(text)])
    return out


class Model(NamedTuple):
    weights: np.ndarray  # what each subword bucket adds to the logit
    slopes: np.ndarray
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        s = subwords(texts)
        z = views(s, self.weights) @ self.slopes + self.offset
        worded = np.zeros(s.texts, bool)
        worded[s.segment_text] = True
        return np.where(worded, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)  # no words, nothing toxic


def constant(rate: float) -> Model:
    """Without both classes: the share of label 1, whatever the text."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS, np.float32), np.zeros(len(VIEWS) + 1), float(np.log(rate / (1 - rate))))


def train(texts: list[bytes], labels: np.ndarray, totals: dict[int, int], seed: int = 7, passes: int = 10, min_documents: int = 3, decay: float = 1e-7, rate: float = 0.1, sharpness: float = 20.0, caution: float = 1.0) -> Model:
    """Embeddings and softmax by Adam on shuffled groups of documents, then the logistic map."""
    if not len(texts) or labels.min() == labels.max():
        return constant(float(totals.get(1, 0)) / max(1, sum(totals.values())))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept = max(1, len(order) * 7 // 10)  # the others fit the logistic map
    order, rest = order[:kept], order[kept:] if len(set(labels[order[kept:]])) == 2 else order
    groups, seen = [], np.zeros((2, 1 << BITS))
    for part in np.array_split(order, max(1, len(order) // 100)):
        s = subwords([texts[i] for i in part])
        if not len(s.words):
            continue
        places = len(s.data) - max(GRAMS)
        span = np.repeat(np.arange(len(s.words), dtype=np.int32), np.diff(np.r_[s.words, places]))
        head = int(s.words[0])
        bucket, word = [], []
        for b, v in s.by_size():
            bucket.append(b[head:][v[head:]])
            word.append(span[v[head:]])
        bucket, word = np.concatenate(bucket), np.concatenate(word)
        by = np.argsort(word, kind="stable")
        bucket, word = bucket[by], word[by]
        del by, span
        many = np.bincount(word, minlength=len(s.words))
        once = np.unique(s.segment_text[s.word_segment[word]].astype(np.int64) << BITS | bucket)
        for c in (0, 1):
            seen[c] += np.bincount(once[labels[part][once >> BITS] == c] & ((1 << BITS) - 1), minlength=1 << BITS)
        groups.append((bucket, many, s.word_segment.astype(np.int32), (1 / np.maximum(many, 1) / SEGMENT).astype(np.float32), s.segment_text, labels[part], len(part)))
        del word, once, s
    if not groups:
        return constant(float(totals.get(1, 0)) / max(1, sum(totals.values())))
    # Subwords of fewer documents keep a zero vector: so few say nothing about them.
    known = np.flatnonzero(seen.sum(0) >= min_documents)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    for i, (b, many, *others) in enumerate(groups):
        b = place[b]
        known_of = np.add.reduceat(np.r_[(b >= 0), False].astype(np.int32), np.cumsum(many) - many) if len(many) else many
        groups[i] = (b[b >= 0], np.where(many > 0, known_of, 0), *others)
    # The vectors start along one direction, by how much likelier toxic documents have the subword, less what chance explains.
    counts, n = seen[:, known], np.bincount(labels[order], minlength=2)
    likelier = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    doubt = caution * np.sqrt((1 / (counts + 0.5)).sum(0))
    likelier = np.sign(likelier) * np.maximum(np.abs(likelier) - doubt, 0)
    rows = np.stack([-np.ones(DIMENSIONS), np.ones(DIMENSIONS)]) * 0.5  # the softmax, a row a class
    vectors = rng.normal(0, 0.1, (len(known), DIMENSIONS)) + (sharpness / DIMENSIONS * likelier)[:, None]
    bias, step = -2.0, 0
    m, v = np.zeros_like(vectors), np.zeros_like(vectors)
    mw, vw, mb, vb = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for _ in range(passes):
        for g in rng.permutation(len(groups)):
            bucket, many, word_segment, word_share, text, label, n_docs = groups[g]
            segment, share = np.repeat(word_segment, many), np.repeat(word_share, many)
            apart = rows[1] - rows[0]
            z = np.bincount(segment, share * (vectors @ apart)[bucket], minlength=len(text)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            # Of a toxic document, what the model finds toxic and its most toxic segment; of others, all.
            best = np.full(n_docs, -np.inf)
            np.maximum.at(best, text, z)
            target = label[text].astype(float)
            weight = np.where((target == 1) & (p < 0.5) & (z < best[text]), 0.0, 1.0)
            weight /= np.where(target == 1, max(1.0, (weight * target).sum()), max(1.0, (weight * (1 - target)).sum()))
            delta = (p - target) * weight
            pull = np.bincount(bucket, share * delta[segment], minlength=len(known))
            step += 1
            slope = pull @ vectors
            grad = pull[:, None] * apart + decay * vectors
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            vectors -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            mw += 0.1 * (slope - mw)
            vw += 0.01 * (slope * slope - vw)
            move = 0.1 * rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8)
            rows += np.stack([move, -move])
            mb += 0.1 * (delta.sum() - mb)
            vb += 0.01 * (delta.sum() ** 2 - vb)
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = vectors @ (rows[1] - rows[0])
    x = np.concatenate([views(subwords([texts[i] for i in rest[j : j + 200]]), weights) for j in range(0, len(rest), 200)])
    y = labels[rest]
    weight = np.array([totals.get(c, 1) / max(1, int((y == c).sum())) for c in (0, 1)])[y]
    slopes, offset = logistic_map(x, y, weight / weight.sum())
    return Model(weights, slopes, offset)


def logistic_map(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    scale = x.std(0) + 1e-9
    x, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 1e-4 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: tuple[int, int] = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``per_class[c]`` training documents of class c, none of the held-out fold.

    Documents are learned from whole, whatever their length; those of a class have at most half of ``sample_bytes``
    together, taken in the order of their ids' hash, and one that no longer fits is left out. One task trains on
    the sample, which has this bound however large the tables; the driver gets the model.
    """
    training = fold(folds) != held_out
    sample = labelled_sample(labels, "toxic", training, per_class)
    # Of rows that repeat an id the one with the least text.
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sizes = picked.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("at")).collect()
    chosen, left = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(sizes, key=lambda r: (r["at"], r["doc_id"])):
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            chosen.append(r["doc_id"])
    if len(chosen) < len(sizes):
        ids = small_table(docs.sparkSession, [(i,) for i in chosen], doc_id=pa.int64())
        picked = picked.join(F.broadcast(ids), "doc_id")
    totals = class_totals(labels, "toxic", training)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), text_bytes(b.column("text")), strict=True))
        model = train([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.int64), totals)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.slopes.tolist()], pa.list_(pa.float64())), pa.array([model.offset], pa.float64())], ["weights", "slopes", "offset"])

    found = picked.select("doc_id", "label", "text").repartition(1).mapInArrow(frugal(fitted), "weights binary, slopes array<double>, offset double").collect()
    if not found:  # an empty table may have no task
        return train([], np.zeros(0, np.int64), totals)
    return Model(np.frombuffer(found[0]["weights"], np.float32), np.array(found[0]["slopes"]), found[0]["offset"])


def toxicity(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    A null, empty or wordless text scores 0. Rows with a
    null id are scored and never held out; repeated rows give a row each; an empty table gives none.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        score = model.scores(text_bytes(part.column("text")))
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_texts(docs.select("doc_id", "text", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out")), work, SCHEMA)
