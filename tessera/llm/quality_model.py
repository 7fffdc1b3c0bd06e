"""Quality: random-indexing word vectors pooled per document, and a two-layer network.

A token is a run of letters and digits (bytes from 128 on too) or of other marks, as it stands, hashed into
``BUCKETS``. Every bucket has a fixed sparse index vector of ``DIMENSIONS`` with two entries of +1 or -1; a
token's vector is the sum of the index vectors of its neighbours at one and two places, over every
document, then scaled to unit length with its own index vector added. A document's vector pools its tokens:
their mean, the deviation of each dimension, and the length of the mean. A network of one hidden layer and a
linear one is trained in numpy on labelled documents; a temperature fitted on labelled documents kept apart
calibrates its probabilities.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, joined_bytes, map_texts, slices, text_bytes
from tessera.llm.folds import fold, labelled_sample

BUCKETS, DIMENSIONS, BLOCKS, REACH = 8192, 32, 32, (1, 2)
#: Bound of the training sample: documents of a class.
PER_CLASS = (6000, 6000)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_byte = np.arange(256)
#: 0 for white space, 1 for letters and digits, 2 for other marks.
KIND = np.where(np.isin(_byte, [32, *range(9, 14)]), 0, np.where((_byte >= 128) | np.isin(_byte, [*range(48, 58), *range(65, 91), *range(97, 123)]), 1, 2)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The two places and the two signs of each bucket's index vector."""
    h = _mixed(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = h % np.uint64(DIMENSIONS)
    second = (first + 1 + (h >> np.uint64(20)) % np.uint64(DIMENSIONS - 1)) % DIMENSIONS
    signs = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)]).astype(np.int64) * 2 - 1
    return np.stack([first, second]).astype(np.int64), signs


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token, and the text that each token is in."""
    data, starts = joined_bytes([t + b"\n" for t in texts])
    kind = KIND[data]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    edge = edge[kind[edge] > 0]
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(np.r_[kind[1:] != kind[:-1], True]) + 1
    ends = change[np.searchsorted(change, edge, side="right")]
    # A polynomial hash of each run from running sums: sums of byte * q^place, times q^-start.
    q = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(q), -1, 1 << 64))
    powers = np.multiply.accumulate(np.full(len(data), q, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.multiply.accumulate(np.full(len(data), inverse, np.uint64))
    hashed = _mixed((sums[ends] - sums[edge]) * back[edge])
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, edge, side="right") - 1


def add_contexts(table: np.ndarray, bucket: np.ndarray, text: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours in the same text."""
    places, signs = index_vectors()
    for reach in REACH:
        same = text[reach:] == text[:-reach]
        left, right = bucket[:-reach][same], bucket[reach:][same]
        for here, there in ((left, right), (right, left)):
            for place, sign in zip(places, signs, strict=True):
                table += np.bincount(here * DIMENSIONS + place[there], sign[there], BUCKETS * DIMENSIONS).astype(np.int64).reshape(table.shape)


def context_table(docs: DataFrame) -> np.ndarray:
    """The summed contexts of every bucket over all documents: a table of fixed size.

    Each task adds up its own documents; blocks of the table are then added 64 at a time, so that no task
    takes more than 64 of them whatever the number of tasks.
    """

    def run(batches):
        table = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for part in slices(batches):
            bucket, text = tokens(text_bytes(part.column("text")))
            if len(bucket):
                add_contexts(table, bucket, text)
        blocks = [(i, b.tobytes()) for i, b in enumerate(np.split(table, BLOCKS)) if b.any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.int64) for b in rows["sums"]], axis=0)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [int(rows["part"].iloc[0])], "sums": [total.tobytes()]})

    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    rows = texts.mapInArrow(frugal(run), "block int, sums binary").withColumn("part", F.spark_partition_id())
    while True:
        rows = rows.withColumn("part", F.expr("cast(part div 64 as int)"))
        rows = rows.groupBy("block", "part").applyInPandas(add, "block int, part int, sums binary")
        parts = -(-parts // 64)
        if parts <= 1:
            break
    table = np.zeros((BLOCKS, BUCKETS // BLOCKS, DIMENSIONS), np.int64)
    for r in rows.collect():  # at most BLOCKS rows of 64 KB
        table[r["block"]] = np.frombuffer(r["sums"], np.int64).reshape(table.shape[1:])
    return table.reshape(BUCKETS, DIMENSIONS)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Contexts less what all words share, at unit length, with half of each word's own index vector."""
    total = np.abs(table).sum(1, keepdims=True) + 1.0
    vectors = table / total
    vectors = vectors - (vectors * total).sum(0) / total.sum()
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    places, signs = index_vectors()
    for place, sign in zip(places, signs, strict=True):
        vectors[np.arange(BUCKETS), place] += 0.5 * sign
    return vectors.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation and length of the mean of each text's word vectors; zeros without tokens."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), np.float32)
    bucket, text = tokens(texts)
    if not len(bucket):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    has, n = text[first], np.diff(np.r_[first, len(text)])[:, None].astype(np.float32)
    each = vectors[bucket]
    mean = np.add.reduceat(each, first, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(each * each, first, axis=0) / n - mean * mean, 0))
    out[has, :DIMENSIONS], out[has, DIMENSIONS:-1], out[has, -1] = mean, spread, np.linalg.norm(mean, axis=1)
    return out


class Network(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 11) -> Network:
    """Adam on four fifths of the rows; the temperature on the others."""
    rng = np.random.default_rng(seed)
    width = 2 * DIMENSIONS + 1
    rate = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():  # one class: its share, whatever the text
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))), 1.0)
    order = rng.permutation(len(y))
    cut = max(1, len(order) // 5)
    apart, own = (order[:cut], order[cut:]) if len(set(y[order[:cut]])) == 2 and len(set(y[order[cut:]])) == 2 else (order, order)
    centre, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = np.clip((x - centre) / scale, -8, 8)
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([np.log(rate / (1 - rate))])]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ p[0] + p[1])
            s = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
            d = (s - y[part]) * weight[part] / weight[part].sum()
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for q, g, a, b in zip(p, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.005 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit = net.logits(x[apart])

    def loss(t: float) -> float:
        return float((weight[apart] * np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t)).sum())

    return net._replace(temperature=min((float(t) for t in np.geomspace(0.5, 20, 120)), key=loss))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: tuple[int, int] = PER_CLASS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents; the network from at most ``per_class[c]`` training documents of class c."""
    vectors = word_vectors(context_table(docs))
    sample = labelled_sample(labels, "quality", fold(folds) != held_out, per_class)

    def run(batches):
        for part in slices(batches):
            x = pooled(text_bytes(part.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in picked.mapInArrow(frugal(run), "doc_id long, label int, x binary").collect())
    totals = {r["c"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & (fold(folds) != held_out)).groupBy(F.col("quality").cast("int").alias("c")).count().collect()}
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], dtype=np.float64).reshape(-1, 2 * DIMENSIONS + 1)
    y = np.array([r[1] for r in rows], dtype=np.int64)
    share = np.array([totals.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)])
    return vectors, train(x, y, share[y] if len(y) else np.zeros(0))


def quality(docs: DataFrame, model: tuple[np.ndarray, Network], folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    A null, empty or blank text scores as the zero vector. Rows with a null id are scored and never held
    out; repeated rows give a row each; an empty table gives none.
    """
    vectors, net = model

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        score = net.scores(pooled(text_bytes(part.column("text")), vectors).astype(np.float64))
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_texts(docs.select("doc_id", "text", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out")), work, SCHEMA)
