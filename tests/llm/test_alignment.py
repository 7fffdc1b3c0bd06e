import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment as align

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", " a", "a ", "\n", "a\nb", "a\n\n b \n", "x▁y", "<|endoftext|> <s> </s>", "é😀 日本語テキスト　 x", "tab\tand\x0bvt\x1c x", "\x00 nul \x00", "a b   c", "don't  we'll  's  ",
    "…  — “q”", "x" * 3000 + " " * 50 + "y", "\r\nfoo\r\n bar", "=-=-=--==" * 50, None, "👩‍👩‍👧 ﬁ Å", "﻿bom", "a b   c",
]


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def of_text(text, first, second):
    """Numbers, links and digest of one text by definition, encoded as a whole."""
    if not text:
        return None
    values = align.byte_values()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(values[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, start = [], Counter(), 0
    for end in sorted(set(ends_a) & set(ends_b)):
        here = [ids[bisect_right(ends, start) : bisect_right(ends, end)] for ids, ends in ((a, ends_a), (b, ends_b))]
        links.update((x, y) for x in here[0] for y in here[1])
        groups.append("|".join(",".join(map(str, x)) for x in here))
        start = end
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def by_definition(texts, tokenizers):
    known = {t: of_text(t, *tokenizers) for t in set(texts)}
    count = Counter(pair for t in texts if known[t] for pair in known[t][3])
    most = {}
    for (a, _), c in count.items():
        most[a] = max(most.get(a, 0), c)
    out = []
    for t in texts:
        n_a, n_b, n_groups, links, digest = known[t] or (0, 0, 0, Counter(), "")
        best = sum(n for pair, n in links.items() if count[pair] == most[pair[0]])
        out.append((n_a, n_b, n_groups, sum(links.values()), best, sum(n * count[pair] for pair, n in links.items()), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows(df):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_equals_the_definition(spark, odd_docs, tokenizers, monkeypatch):
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 96").select("doc_id", "text").union(spark.createDataFrame([(200 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    source = docs.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(source, by_definition([r.text for r in source], tokenizers), strict=True))
    assert rows(align.aligned(odd_docs.where("doc_id IS NULL OR doc_id <> 96").unionByName(docs.where("doc_id >= 200"), allowMissingColumns=True), *FILES)) == want
    assert rows(align.aligned(docs.repartition(5, "text"), *FILES, buckets=1)) == want


def test_real_texts(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source = docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(source, by_definition([r.text for r in source], tokenizers), strict=True))
    assert rows(align.aligned(docs, *FILES)) == want


def test_a_text_larger_than_a_lot_and_an_empty_table(spark, no_docs, tokenizers):
    line, lines = "lorem ipsum " * 20 + "\n", 18_000
    (got,) = align.aligned(spark.createDataFrame([(1, line * lines)], "doc_id long, text string"), *FILES).collect()
    # Every further line adds what the third adds to two.
    n = [[len(tokenizers[0].encode(" " + line * k, add_special_tokens=False).ids), len(tokenizers[1].encode(line * k))] for k in (2, 3)]
    assert [got.n_a, got.n_b] == [two + (three - two) * (lines - 2) for two, three in zip(*n, strict=True)]
    assert got.n_best == got.n_links > 0  # one text: every pair counts once
    assert got.count_sum == got.n_links
    assert align.aligned(no_docs, *FILES).collect() == []


def test_forgetting_and_large_groups_change_nothing(tokenizers, monkeypatch):
    monkeypatch.setattr(align, "MEMO_BYTES", 0)
    monkeypatch.setattr(align, "GROUP_LINKS", 1)
    aligner = align.Aligner(*FILES)
    for _ in range(2):
        numbers, digests, pairs, place, times = aligner.lot([t or "" for t in ODD])
        found = [Counter() for _ in ODD]
        for pair, i, n in zip(pairs.tolist(), place.tolist(), times.tolist(), strict=True):
            found[i][pair >> align.ID_BITS, pair & align.ID_MASK] += n
        for text, row, digest, links in zip(ODD, numbers.tolist(), digests, found, strict=True):
            n_a, n_b, n_groups, want, sha = of_text(text, *tokenizers) or (0, 0, 0, Counter(), "")
            assert (row, digest, links) == ([n_a, n_b, n_groups, sum(want.values())], sha, want)


def test_squeezed_numbers_come_back():
    for values in ([], [0], [1, 2, 300, 70_000, 2**32 - 1], [2**40, 5, 0]):
        assert align.unsqueezed(align.squeezed(np.array(values, dtype=np.int64))).tolist() == values
