"""Scores and vectors of the classifiers by their definition, one word and one character after the other."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import quality_model as quality
from tessera.llm import toxicity as toxic

ODD = ["", " \n", "Hello, WORLD! hello", "é😀 x", "a", "ab" * 40, "one two  three\tfour-five_six 7", "\x00 z\x00z", *(" ".join("abcdefgh"[(i * k) % 7 :][: 1 + (i + k) % 5] for k in range(60 * i)) for i in range(1, 6))]
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def bucket_of(gram):
    h = gram[0]
    for size, byte in enumerate(gram[1:], 2):
        h = (((h ^ (h >> 15)) * 0x01000193) + byte) & M32
    return (((h ^ len(gram)) * 0x9E3779B1) & M32) >> (32 - toxic.BITS)


def toxicity_by_definition(text, model):
    """Words between marks, their subwords' mean weight, the strongest segment of each size and the mean of all words."""
    folded = bytes(int(toxic.FOLDED[b]) for b in text.encode())
    each = []
    for word in re.findall(rb"[^\0]+", folded):
        padded = b"\0" + word + b"\0"
        grams = [padded[i : i + n] for n in toxic.GRAMS for i in range(len(padded) - n + 1)]
        each.append(sum(float(model.weights[bucket_of(g)]) for g in grams) / max(1, len(grams)))
    if not each:
        return 0.0
    seen = [max(sum(each[i : i + size]) / size for i in range(0, len(each), size)) for size in toxic.VIEWS] + [sum(each) / len(each)]
    z = sum(a * b for a, b in zip(seen, model.slopes, strict=True)) + model.offset
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_toxicity_scores():
    rng = np.random.default_rng(4)
    model = toxic.Model(rng.normal(size=1 << toxic.BITS).astype(np.float32), rng.normal(size=len(toxic.VIEWS) + 1), -0.3)
    np.testing.assert_allclose(model.scores([t.encode() for t in ODD]), [toxicity_by_definition(t, model) for t in ODD], atol=1e-4)


def quality_tokens(text):
    """Runs of letters and digits, and runs of other marks, as buckets."""
    out = []
    for run in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", text.encode()):
        h, power = 0, 1
        for byte in run:
            h, power = (h + (byte + 1) * power) & M64, power * 0x9E3779B97F4A7C15 & M64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor & M64
        out.append((h ^ (h >> 31)) % quality.BUCKETS)
    return out


def test_quality_tokens():
    bucket, text = quality.tokens([t.encode() for t in ODD])
    found = defaultdict(list)
    for b, t in zip(bucket.tolist(), text.tolist(), strict=True):
        found[t].append(b)
    assert [found[i] for i in range(len(ODD))] == [quality_tokens(t) for t in ODD]


def test_word_vectors_from_all_documents(spark, no_docs):
    table = quality.context_table(spark.createDataFrame([(t,) for t in [*ODD, None]], "text string").repartition(5))
    places, signs = quality.index_vectors()
    want = np.zeros_like(table)
    for text in ODD:
        own = quality_tokens(text)
        for i, here in enumerate(own):
            for reach in quality.REACH:
                for j in (i - reach, i + reach):
                    if 0 <= j < len(own):
                        for k in range(2):
                            want[here, places[k, own[j]]] += signs[k, own[j]]
    assert (table == want).all() and not quality.context_table(no_docs).any()


def test_pooled_vectors():
    vectors = np.random.default_rng(6).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    got = quality.pooled([t.encode() for t in ODD], vectors)
    for text, row in zip(ODD, got, strict=True):
        own = vectors[quality_tokens(text)].astype(float)
        if not len(own):
            assert not row.any()
            continue
        mean = own.mean(axis=0)
        np.testing.assert_allclose(row, np.r_[mean, own.std(axis=0), np.linalg.norm(mean)], atol=2e-3)


@pytest.mark.parametrize("rate", [0.0, 0.2, 1.0])
def test_without_both_classes_the_share_counts(rate):
    model = toxic.constant(rate)
    assert model.scores([b"word", b""]) == pytest.approx([rate, 0.0], abs=2e-6)
