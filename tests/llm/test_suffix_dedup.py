"""Repeated strings: the sort against sorted(), the operator against brute force."""

import hashlib
import random
from collections import Counter

from tessera.llm import suffix_dedup as S


def brute(texts):
    seen = Counter(t[i : i + S.SPAN] for t in texts for i in range(len(t) - S.SPAN + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - S.SPAN + 1):
            if seen[t[i : i + S.SPAN]] > 1:
                gone[i : i + S.SPAN] = b"\1" * S.SPAN
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_deep_shallow_order():
    rng = random.Random(5)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 60))]
        order = S.deep_shallow_order(strings, rng.randrange(0, 5))
        assert [strings[i] for i in order] == sorted(strings)
        assert sorted(order) == list(range(len(strings)))
    long = [b"x" * 60 + bytes(rng.choice(b"ab") for _ in range(140)) for _ in range(300)] + [b"x" * 60 + b"a" * k for k in range(100)]
    assert [long[i] for i in S.deep_shallow_order(long)] == sorted(long)


def test_buckets_small_and_large_agree(monkeypatch):
    rng = random.Random(6)
    lefts = [bytes(rng.choice(b"ab") for _ in range(3)) * rng.randrange(0, 40) for _ in range(60)]
    lefts = [x[: S.BEFORE] for x in lefts]
    rights = [b"g" * S.GRAM + bytes(rng.choice(b"ab") for _ in range(2)) * rng.randrange(0, 68) for _ in range(60)]
    large = S.spans_of_bucket(lefts, rights, [1] * 60)
    monkeypatch.setattr(S, "PAIRWISE", 100)
    assert S.spans_of_bucket(lefts, rights, [1] * 60) == large


def test_against_brute_force(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, brute([(r["text"] or "").encode() for r in rows])))
    got = sorted((str(r[0]), *r[1:]) for r in S.suffix_dedup(odd_docs).collect())
    assert got == want


def test_random_tables(spark):
    rng = random.Random(7)
    for trial in range(3):
        pool = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(80, 420))).decode() for _ in range(8)]
        texts = ["".join(rng.choice(pool)[rng.randrange(0, 60) :] for _ in range(rng.randrange(1, 5))) for _ in range(25)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = sorted((i, *w) for i, w in enumerate(brute([t.encode() for t in texts])))
        assert sorted(tuple(r) for r in S.suffix_dedup(docs).collect()) == want


def test_pipeline_form(odd_docs, no_docs):
    out = S.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r["text"] for r in out.where("doc_id between 70 and 75").collect()} == {""}
    assert S.suffix_dedup(no_docs).count() == 0
