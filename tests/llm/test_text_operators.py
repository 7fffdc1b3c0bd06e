"""HTML, token counts, media and packing: round trips and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import html_extract as H
from tessera.llm import media as M
from tessera.llm import packing as P
from tessera.llm import token_counts as C

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", " a", "a ", "a  b", "▁x y", "x\n\ny", "ab" * 4000, " " * 5000, "a " * 4000, "é́" * 900 + "中文" * 900, "<s> </s>" * 500, "\U0001f600ਅx" * 700, "don't <|endoftext|>x É's İΣΑΣ ÿŸ ſ ß, 12ab \x00z"]


def test_token_counts(odd_docs, no_docs):
    counter = C.counter(MODEL)
    assert counter.counts(ODD) == [len(x) for x in counter.model.encode(ODD, num_threads=1)]
    for text in ODD:
        for chunk, overlap in ((100, 8), (37, 1), (2000, 64)):
            assert counter.count_long(text, chunk, overlap) == len(counter.model.encode(text)) or not text
    rows = {r["doc_id"]: r for r in C.token_counts(odd_docs, MODEL).collect()}
    assert (rows[90]["n_bytes"], rows[90]["n_tokens"], rows[90]["over_limit"]) == (0, 0, False)
    assert rows[96]["n_tokens"] == len(counter.model.encode("x " * 40_000)) and rows[96]["over_limit"]
    assert C.token_counts(no_docs, MODEL).count() == 0


@pytest.mark.parametrize("compression", [M.NONE, M.LZW, M.DEFLATE, M.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 255, (37, 50, 3)).astype("u1"), rng.integers(0, 6000, (20, 64)).astype("u2"), np.zeros((5, 300), "u1")]
    stored = M.write_tiff(images, compression, predictor, 8, tile)
    assert [p.data for p in M.read_pages(stored)] == [i.tobytes() for i in images]


def test_codecs():
    rng = random.Random(2)
    for _ in range(40):
        data = bytes(rng.choice([rng.randrange(256), 0, 65]) for _ in range(rng.randrange(0, 9000)))
        assert M.lzw_decode(M.lzw_encode(data)) == data
        assert M.unpack_bits(M.pack_bits(data)) == data


def test_pages_of_a_column(spark):
    good = M.write_tiff([np.zeros((2, 3), "u1"), np.ones((4, 1), "u1")])
    rows = M.tiff_pages(spark.createDataFrame([(1, good), (2, b"no"), (3, None), (4, good[:40])], "id long, content binary")).collect()
    assert [(r["id"], r["page"], r["width"], r["height"]) for r in rows if r["error"] is None] == [(1, 0, 3, 2), (1, 1, 1, 4)]
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4}


def test_text_media(odd_docs, no_docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.collect()}
    for r in M.text_media(odd_docs).collect():
        payload = M.payload_of(texts[r["doc_id"]])
        assert len(payload) % 64 == 0 and payload
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert M.text_media(no_docs).count() == 0


def test_damaged_pages_are_errors(spark):
    import struct

    image = np.arange(24 * 80, dtype="u1").reshape(24, 80)

    def changed(stored, tag, value, at=8):
        entry = struct.pack("<H", tag)
        (where,) = struct.unpack_from("<I", stored, 4)
        (n,) = struct.unpack_from("<H", stored, where)
        place = next(where + 2 + 12 * i for i in range(n) if stored[where + 2 + 12 * i :][:2] == entry)
        return stored[: place + at] + struct.pack("<I", value) + stored[place + at + 4 :]

    for compression in (M.NONE, M.DEFLATE, M.LZW, M.PACKBITS):
        whole = M.write_tiff([image], compression, 1, 24)
        three = M.write_tiff([image], compression, 1, 8)
        files = [whole, changed(whole, M.LENGTH, 48), changed(whole, M.LENGTH, 1 << 31), changed(whole, M.STRIP_COUNTS, 1 << 30), changed(three, M.ROWS_PER_STRIP, 4), changed(whole, M.STRIP_OFFSETS, 1 << 30)]
        rows = {r.id: r for r in M.tiff_pages(spark.createDataFrame(list(enumerate(files)), "id long, content binary")).collect()}
        assert rows[0].error is None and bytes(rows[0].samples) == image.tobytes()
        assert all(rows[i].error and rows[i].samples is None for i in range(1, len(files)))
    assert M.tiff_pages(spark.createDataFrame([], "id long, content binary")).collect() == []


def test_every_compression_is_among_the_texts(spark):
    texts = ["", *("".join(chr(97 + (i * k + k // 7) % 26) * (1 + k % 5) for k in range(i * 37)) for i in range(60)), "x" * 200_000]
    rows = M.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    forms = {re.search(r"compression=(\d+)", r.feature)[1] for r in rows}
    assert forms == {str(c) for c in (M.NONE, M.LZW, M.PACKBITS, M.DEFLATE)}
    assert {"tiled=True", "tiled=False"} <= {re.search(r"tiled=\w+", r.feature)[0] for r in rows} and any("4 pages" in r.feature for r in rows)
    for r in rows:
        payload = M.payload_of(texts[r.doc_id].encode())
        assert (r.payload_bytes, r.payload_sha256, r.media_bytes) == (len(payload), hashlib.sha256(payload).hexdigest(), len(M.stored_form(payload)))


def test_packing(odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    got = P.WordEncoder(WORDS).encode([t.encode() for t in ODD])
    assert [list(g) for g in got] == [e.ids + [0] for e in tokenizer.encode_batch(ODD, add_special_tokens=False)]
    rows = P.packed(odd_docs, WORDS, 256).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 256) + 2
    assert [(r["piece"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 90] == [(0, 1, zlib.crc32(bytes(4)))]
    assert sum(r["doc_id"] == 5 for r in rows) % 2 == 0
    assert P.packed(no_docs, WORDS).count() == 0


def test_large_ids_beside_null_ones(spark):
    docs = spark.createDataFrame([(None, "one two"), (2**53 + 1, "three"), (2**63 - 1, "four"), (None, "one two")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in P.packed(docs, WORDS).collect()) == sorted([str(2**53 + 1), str(2**63 - 1), "None", "None"])


def test_word_encoder_against_the_library():
    import random

    tokenizer, rng = Tokenizer.from_file(WORDS), random.Random(1)
    texts = ["don't we'RE x''s 's 'select 'r 've'll 12'd3 !'s 'sé 'É's", "'s", "a'", "\u0141\u00d3D\u0179 \u0178\u00ff\u0130\u0131\u0149 \u1e9e\u00df E\u0301 a\u0338", "<|endoftext|> <|end a<|startoftext|>b <", "\x1c\x1f \x00 \x7f", "x" * 100 + " " + "\u00e9" * 40 + "'" * 30, "a\u00a0b\u0085c\u200b"]
    letters = list("aAbZ sStTdDmMrRvVeElL'''' 019!.,<|>#\n\t\u00c9\u00e9\u00df\u0141\u0142\u0130\u0153\u0301\u00a0\u65e5")
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    want = [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = P.WordEncoder(WORDS)
    assert [g.tolist() for t in texts[:300] for g in encoder.encode([t.encode()])] == want[:300]
    for _ in range(2):  # with nothing known, and with all parts known
        assert [g.tolist() for g in encoder.encode([t.encode() for t in texts])] == want


def two_fit_by_trying(lengths, capacity):
    """What ``best_two_fit`` promises, by trying every pair: the lengths of each sequence."""
    stock, out = sorted(lengths, reverse=True), []
    while stock:
        gap, own = capacity, []
        while fit := [x for x in stock if x <= gap]:
            own.append(fit[0])
            stock.remove(fit[0])
            gap -= fit[0]
        if gap:
            wide = gap + min(own)
            pairs = [(stock[i] + stock[j], stock[i], stock[j]) for i in range(len(stock)) for j in range(i) if stock[i] + stock[j] <= wide]
            if pairs and max(pairs)[0] > min(own):
                stock.append(min(own))
                own.remove(min(own))
                two = next(p for p in sorted(pairs, key=lambda p: (-p[0], min(p[1:]))))
                for x in two[1:]:
                    own.append(x)
                    stock.remove(x)
                stock.sort(reverse=True)
        out.append(sorted(own))
    return out


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for _ in range(100):
        capacity = int(rng.integers(2, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 120))
        sequence, offset = P.best_two_fit(lengths, capacity)
        for s in set(sequence):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert lengths[own].sum() <= capacity
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        assert [sorted(lengths[sequence == s].tolist()) for s in range(sequence.max() + 1)] == two_fit_by_trying(lengths.tolist(), capacity)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">Menu &gt; %d</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy %d</div><div class="cookie-notice">We use</div>
<article><h1>Head  %d</h1><p><b>One &amp; <i>two</i>%d.<br>three<p>Four&nbsp;x</p><form><p>Sign up</p></form><section class="comments"><p>Nice</p></section></article>
<aside>Side</aside><footer>&copy; us</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE % (i, i, i, i)) for i in range(8)]
    rows += [(50, "http://lone.org/", PAGE % (1, 1, 1, 1)), (51, None, None), (52, "http://lone.org/2", ""), (53, "x", "plain <b>text</b> & more < 3"), (54, "x", "<p>cut off <a href="), (0, rows[0][1], rows[0][2])]
    rows += [(60 + i, f"http://plain.org/{i}", f"<html><body><div>Same words</div><div>Own words {i}</div><div>Same end</div></body></html>") for i in range(5)]
    got = {r["page_id"]: r for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Head {i}\n\nOne & two{i}. three\n\nFour x"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[50]["text"].startswith("Head 1")
    assert got[51]["text"] == got[52]["text"] == ""
    assert got[53]["text"] == "plain text & more < 3" and got[54]["text"] == "cut off"
    assert got[62]["text"] == "Own words 2"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_main_text(empty).count() == 0


def test_templates_of_copies_and_layouts(spark):
    article = "<html><body><div><p>One line</p><p>Two lines</p><p>Three lines</p></div></body></html>"
    rows = [(i, f"http://copies.org/{i}", article) for i in range(9)]
    for i in range(24):  # four layouts, each on a quarter of the pages
        k = i % 4
        menu = "".join(f"<a>Menu {k} {word}</a>" for word in ("home", "news", "about"))
        rows.append((100 + i, f"http://layouts.org/{i}", f'<html><body><div class="top{k}">{menu}</div><div class="body{k}"><p>Own words {i}</p></div></body></html>'))
    # Three near copies on a host of many pages with one layout are no template of it.
    for i in range(20):
        body = "".join(f"<p>{'shared' if i < 3 else f'own {i}'} line {j}</p>" for j in range(4))
        rows.append((200 + i, f"http://near.org/{i}", f"<html><body><div>{body}<p>Page {i}</p></div></body></html>"))
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(9)} == {"One line\n\nTwo lines\n\nThree lines"}
    assert all(got[100 + i] == f"Own words {i}" for i in range(24))
    assert all("shared line 3" in got[200 + i] for i in range(3))


def test_nested_checks_all_kept_classes():
    # 100 classes side by side, then a pair that crosses the last of them and one that crosses none.
    sequence = [k for i in range(100) for k in (3 * i, 3 * i + 1, 3 * i + 2)]
    classes = {k: k // 3 for k in sequence}
    sequence[299:299] = [1000]
    sequence += [1001]
    classes |= {1000: 500, 1001: 500}
    assert H.nested(sequence, classes, set(classes.values())) == set(range(100))
    rng = np.random.default_rng(3)
    for _ in range(300):
        numbers = rng.integers(0, 90, 250).tolist()
        classes = {i: n for i, n in enumerate(numbers)}
        spans = {n: (numbers.index(n), 249 - numbers[::-1].index(n), numbers.count(n)) for n in set(numbers)}
        kept: list[int] = []
        for n in sorted(spans, key=lambda n: (-spans[n][2], n)):
            (low, high, _), others = spans[n], [spans[k] for k in kept]
            if not any(a < low <= b < high or low < a <= high < b for a, b, _ in others):
                kept.append(n)
        assert H.nested(list(range(250)), classes, set(numbers)) == set(kept)


def test_token_paths():
    deep = "<div>" * 3000 + "x" + "</span>" * 3000
    assert H.main_text(deep, {}) == "x"
