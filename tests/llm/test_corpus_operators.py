"""Similarity, mixing, rules and classifiers: brute force and held-out accuracy; the pipeline as a whole."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import jaccard as J
from tessera.llm import mixing as X
from tessera.llm import quality_model, quality_rules, stages, toxicity
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DATA = "/root/testdata/sf0.01"


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_jaccard_components(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(odd_docs).collect())
    assert got == brute_components(rows)
    assert J.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("common", [4, 1 << 20])
def test_jaccard_chains_and_common_passages(spark, monkeypatch, common):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    rows, passage = [], " ".join(f"p{i}" for i in range(30))
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        base[int(rng.integers(60))] = f"x{i}"
        rows.append((i, " ".join(base)))
    for i in range(40):
        own = " ".join(f"q{i}_{k}" for k in range(int(rng.integers(3, 60))))
        rows.append((100 + i, own + " " + passage))
    monkeypatch.setattr(J, "COMMON_DOCUMENTS", common)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == brute_components(rows)


def test_gram_sets_of_lone_texts():
    texts = [" ".join(f"w{i}" for i in range(n)).encode() for n in range(7)]
    together = J.gram_sets(texts + [b"a longer text that stands in the same slice"])
    for text, want in zip(texts, together, strict=False):
        for words in (3, 4, 5):
            assert len(J.gram_sets([text], words)) == 1
        assert J.gram_sets([text])[0].tolist() == want.tolist()


def test_lists_of_a_bucket():
    # Five copies of each posting, as from several slices: a long list, a short one, a lone posting.
    rows = [(7, 20 + name // 4, name) for name in range(1, 13) for _ in range(5)] + [(9, 20, 1), (9, 20, 2), (9, 20, 1), (11, 20, 3), (8, 20, 2), (8, 20, 1), (8, 40, 3)]
    gram, n, name = (np.array(x) for x in zip(*rows, strict=True))
    found = list(zip(*(x.tolist() for x in J.lists(gram.astype(np.uint64), name, n)), strict=True))
    assert [f for f in found if f[0] == 0] == [(0, 1, 2, 2)]  # sizes of 20 and 40 cannot be similar
    assert {f[1:] for f in found if f[0] == 1} == {(7, name, 20 + name // 4) for name in range(1, 13)}
    assert len(J.lists(gram[:0].astype(np.uint64), name[:0], n[:0])[0]) == 0


def test_common_ngrams_go_last():
    order = J.Order(1, np.zeros(1 << (J.COMMON_BITS - 3), np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams = np.arange(1, 21, dtype=np.uint64) << np.uint64(64 - J.COMMON_BITS)
    order.common[0] |= 0b10  # the first n-gram is common
    kept, of = J.prefixes([grams, grams[:0], grams[:1]], order)
    assert kept[of == 0].tolist() == grams[1:7].tolist() and kept[of == 2].tolist() == grams[:1].tolist()


def test_large_group_of_near_copies(spark, monkeypatch):
    """Hubs, hot n-grams dealt to several buckets, and several buckets, against brute force."""
    monkeypatch.setattr(J, "HOT_DOCUMENTS", 20)
    monkeypatch.setattr(J, "BUCKET_GRAMS", 500)
    monkeypatch.setattr(J, "HELD_GRAMS", 700)
    monkeypatch.setattr(J, "HELD_POSTINGS", 300)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 9))):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and {got[i] for i in (100, 101, 103)} == {100}


def test_targets():
    assert X.targets([100, 10, 5, 50], [5, 2, 1, 5]) == [117.5, 20.0, 10.0, 100.0]
    assert X.targets([], []) == []
    draws = X.shard_draws(np.array([10, 0, 37]), 5, 3)
    assert draws.sum(0).tolist() == [10, 0, 37]
    for m in (1, 2, 7, 64, 1000):
        order = X.Permutation.of(m, 5, 1)
        there = order.forward(np.arange(m))
        assert sorted(there) == list(range(m)) and order.backward(there).tolist() == list(range(m))
    steps = np.diff(X.Permutation.of(1 << 45, 5, 1).forward(np.arange(1000)))
    assert len(set(steps.tolist())) == 999 and 300 < (steps > 0).sum() < 700


def test_mixture(spark, odd_docs, no_docs):
    rows = X.mixture(odd_docs, block_words=4).collect()
    sizes = [len(WORD.findall(r["text"] or "")) for r in odd_docs.collect()]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in odd_docs.collect()}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(8, 0.02 * target[s]) for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes))
    assert sorted(map(str, rows)) == sorted(map(str, X.mixture(odd_docs, block_words=4).collect()))
    assert X.mixture(no_docs).count() == 0


def test_every_word_has_a_shard_and_a_slot(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(7 + i % 40)), "abc"[i % 3]) for i in range(200)] + [(None, "x y z " * 30, "a"), (None, "p q r " * 30, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = X.sized_documents(docs)
    plan = X.source_plan(sized)
    drawing = [X.source_draw(s, t, 17_000 + i, 8) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))]
    for shards in (1, 7):
        draws = X.shard_draws(np.array([d.slots for d in drawing]), shards, 17)
        slots = X.drawn_slots(spark, drawing, 17, shards).collect()
        found = np.zeros_like(draws)
        for r in slots:
            found[r.shard, r.number] += 1
        assert (found == draws).all() and len({(r.number, r.slot) for r in slots}) == len(slots)
        words = defaultdict(int)
        for r in X.mix_blocks(sized, plan, len(rows), block_words=8, shards=shards).collect():
            for place in r.places:
                words[place.shard] += r.last - r.first
        # A shard's slots are blocks of 8 words, but for each source's last block and last slot.
        assert all(8 * (draws[k].sum() - 2 * len(plan.sources)) <= words[k] <= 8 * draws[k].sum() for k in range(shards))
        out = X.mixture(docs, block_words=8, shards=shards).collect()
        assert {s for r in out for s in r.shards} == set(range(shards)) and all(bool(r.shards) == (r.taken > 0) for r in out)


def test_ids_with_several_texts_keep_their_own_words(spark):
    rows = [(1, "a b c d", "s"), (1, "e f g h", "s"), (None, "i j k", "s"), (None, "l m n", "s"), (1, "a b c d", "s")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long")
    one, two = (sorted(map(str, stages.mix_sources(spark, d, "").collect())) for d in (docs, docs.repartition(3, "text")))
    assert one == two and len(one) >= 5


def test_mixture_of_small_sources(spark):
    sizes = {"a": 16, "b": 33, "c": 70, "d": 5000, "e": 1, "f": 200, "g": 129, None: 10}
    rows, words = [], 0
    for source, size in sizes.items():
        for at in range(0, size, 45):  # documents that cross the blocks
            rows.append((len(rows), " ".join(f"w{words + k}" for k in range(min(45, size - at))), source))
            words += min(45, size - at)
    for seed in (17, 18):
        out = X.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed).collect()
        taken, target = defaultdict(int), {}
        for r in out:
            assert r["taken"] <= 2 * r["size"]
            taken[rows[r["doc_id"]][2]] += r["taken"]
            target[rows[r["doc_id"]][2]] = r["target"]
        assert dict(taken) == {s: round(t) for s, t in target.items()}
    assert target["e"] == 2 and target[None] == 20 and sum(taken.values()) == pytest.approx(1.5 * words, abs=8)


def test_source_draw():
    for size in (1, 2, 63, 64, 65, 130, 1000):
        for target in range(2 * size + 1):
            d = X.source_draw(size, target, 3, 64)
            times = np.zeros(size, int)
            for k in range(d.slots):
                block = int(d.turns[k // d.blocks].forward([k % d.blocks])[0])
                times[64 * block : 64 * block + 64] += 1
            times[d.low : d.high] -= 1
            assert times.sum() == target and times.min() >= 0 and times.max() <= 2 and times.max() - times.min() <= 1


def brute_rules(text):
    words, again = WORD.findall(text), defaultdict(list)
    for i in range(len(words) - 4):
        again[tuple(words[i : i + 5])].append(i)
    inside = {j for at in again.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(c - 1 for c in lines.values()), len(inside), n < 10 or 100 * len(inside) > 20 * n)


def test_quality_rules(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    rows = quality_rules.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(no_docs).count() == 0


def prose(rng, letters, rows, words=120):
    """Texts over an alphabet whose letters follow each other by fixed rules."""
    after = {c: rng.choice(list(letters), 3) for c in letters}
    out = []
    for _ in range(rows):
        text, c = [], letters[0]
        for _ in range(words):
            word = []
            for _ in range(int(rng.integers(3, 9))):
                c = after[c][int(rng.integers(3))]
                word.append(c)
            text.append("".join(word))
        out.append(" ".join(text))
    return out


def test_every_language_has_its_own_model(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(30):  # more than the 24 languages of a lot's tables; lots forced small
        for text in prose(rng, "abcdefghijklmnopqrstuvwxyz", 12):
            rows.append((len(rows), text, f"l{k:02d}"))
    # Texts that no model learns from, for their symbols: under their own language and under another.
    extra = [(10_000 * (1 + d) + k, rows[12 * k + 3][1] + " #" * 15, f"l{(k + d) % 30:02d}") for k in range(30) for d in (0, 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    whole = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert {r["lang_group"] for r in whole.values()} == {f"l{k:02d}" for k in range(30)}
    assert all(whole[20_000 + k]["log_perplexity"] > whole[10_000 + k]["log_perplexity"] for k in range(30))
    assert len(quality_rules.lots([("a", 5), ("b", 4), ("c", 1), ("d", 9)], 9)) == 3
    real = quality_rules.lots
    monkeypatch.setattr(quality_rules, "lots", lambda sizes, most: real(sizes, 20_000))
    parts = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert parts.keys() == whole.keys()
    assert all(parts[i]["log_perplexity"] == pytest.approx(whole[i]["log_perplexity"]) and parts[i]["kept"] == whole[i]["kept"] for i in whole)


@pytest.mark.parametrize("letters", ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "".join(map(chr, range(0x4E00, 0x4E60)))])
def test_shuffled_letters_of_other_scripts_are_rejected(spark, letters):
    rng = np.random.default_rng(7)
    texts = prose(rng, letters, 60)
    bad = [" ".join("".join(rng.permutation(list("".join(t.split()))))[i : i + 5] for i in range(0, 500, 5)) for t in texts[:6]]
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(100 + i, t, "xx") for i, t in enumerate(bad)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(6))


def test_kneser_ney_sums_to_one():
    codes = np.unique(np.random.default_rng(1).integers(0, 32**4, 5000).astype(np.uint32))
    model = quality_rules.kneser_ney(codes, np.random.default_rng(2).geometric(0.4, len(codes)))
    sums = np.exp(model.table().astype(float)).reshape(-1, 32).sum(1)
    assert sums.min() == pytest.approx(1, abs=1e-4) and sums.max() == pytest.approx(1, abs=1e-4)
    assert (np.diff(model.keys.astype(object)) > 0).all()


def test_rules_reject_junk_and_keep_prose(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.3 * len(bad)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for module, fit, label, folds, held in ((quality_model.quality, quality_model.fit_quality, "quality", 5, 0), (toxicity.toxicity, toxicity.fit_toxicity, "toxic", 4, 2)):
        rows = module(docs, fit(docs, labels)).collect()
        assert len(rows) == docs.count()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        truth = {r["doc_id"]: r[label] for r in labels.collect()}
        own = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
        pairs = [(a > b) + 0.5 * (a == b) for a, x in own for b, y in own if x == 1 and y == 0]
        assert sum(pairs) / len(pairs) > 0.75, label


def test_classifiers_on_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for docs in (odd_docs, no_docs):
            assert quality_model.quality(docs, quality_model.fit_quality(docs, labels)).count() == docs.count()
            assert toxicity.toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == docs.count()


def test_toxic_words_and_misspellings():
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeiorstnl"), 6)) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            words[int(rng.integers(60))] = "blockhead"
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels), Counter(labels))
    scores = model.scores([b"tone blockheadd rest", b"tone rest least", b""])
    assert scores[0] > 0.3 > scores[1] and scores[2] < 0.3


def test_pipeline_stages(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, int(i < 3)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        after = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name == "ngram_jaccard_join":
            groups = J.jaccard_components(docs).where("n_shingles > 0 and doc_id is not null").select("component_id").distinct().count()
            assert after.where("doc_id is not null and length(trim(text)) > 0").select("doc_id").distinct().count() >= groups - 1
            ids = [r["doc_id"] for r in after.collect() if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and 71 not in ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        docs = after
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
