"""Empty tables through every stage, slices, clashing names, ids with two labels."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, folds, html_extract, jaccard, media, membership, quality_rules, suffix_dedup, toxicity
from tessera.llm.components import components

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_no_documents(spark, name, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    out = stage(spark, docs, DATA)
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_with_two_labels_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, toxic int")
    rows = folds.labelled_sample(labels, "toxic", F.lit(True), (10, 10)).collect()
    assert sorted(map(tuple, rows)) == [(2, 1), (3, 0)]


def test_pages_with_clashing_columns(spark):
    page = "<html><body><nav>Menu</nav><article><p>One</p><p>Two</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page.replace("One", f"One {i}"), "h", "c", 1, "t") for i in range(4)] + [(9, None, None, "h", "c", 1, "t")], "page_id long, url string, html string, host string, classes string, n_chars int, text string")
    out = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert out == {**{i: f"One {i}\n\nTwo" for i in range(4)}, 9: ""}


def test_texts_beyond_a_slice(spark):
    body = " ".join(f"word{i}" for i in range(160_000))  # 1.5 MB
    docs = spark.createDataFrame([(1, body, "en", "s"), (2, "x " + body, "en", "s"), (3, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert removed == {1: (len(body), len(body)), 2: (len(body) + 2, len(body)), 3: (5, 0)}
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(docs).collect()} == {1: 160_000, 2: 160_001, 3: 1}
    assert {r.doc_id: r.n_bytes for r in media.text_media(docs).collect()} == {1: len(body), 2: len(body) + 2, 3: 5}


def test_join_across_components_leaves_out_what_only_shares_lists(spark):
    """Thirty sets of 100 n-grams with the same 25 in their lists, of which one has a near copy: not all 465 pairs are made."""
    rng = np.random.default_rng(5)
    shared = rng.integers(1 << 63, size=25, dtype=np.uint64)
    sets = {name: np.concatenate([shared, rng.integers(1 << 63, size=75, dtype=np.uint64)]) for name in range(30)}
    sets[30] = np.concatenate([sets[7][:86], rng.integers(1 << 63, size=14, dtype=np.uint64)])  # 86 of 114
    rows = [(name, f, np.sort(s)[f::2].tobytes()) for name, s in sets.items() for f in (0, 1)]
    pieces = spark.createDataFrame(rows, "name long, fragment int, grams binary")
    none = spark.createDataFrame([], "a long, b long, c long")

    def found(lists, spare):
        members = spark.createDataFrame([(int(g), name, 100, lists, spare, name) for name in sets for g in shared], "gram long, name long, n long, lists long, spare long, label long")
        return [(r.a, r.b, r.c) for r in jaccard.pairs_across(members, none, pieces).collect()]

    assert found(25, 24) == [(7, 30, 25)]
    assert found(35, 34) == [(7, 30, 25)]
    # Ten lists that are of one component use up ten of the n-grams that a class can do without.
    assert found(35, 9) == []


@pytest.mark.parametrize("n", [300])
def test_components_write_small_tables_in_few_files(spark, monkeypatch, n):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 10 != 9], "a long, b long")
        got = components(edges)
        assert len(got.inputFiles()) <= 12
        assert {r["node"]: r["label"] for r in got.collect()} == {i: i // 10 * 10 for i in range(n)}
        monkeypatch.setattr(common, "TASK_ROWS", 20)  # a greater table has more tasks
        assert 12 < len(components(edges).inputFiles()) <= 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_links_inside_components_change_nothing(spark):
    of = lambda rows: spark.createDataFrame(rows, "a long, b long")
    links = of([(1, 2), (2, 3), (7, 8)])
    labels = components(links)
    assert jaccard.joined_links(links, of([(1, 3), (8, 7)]), labels) == (links, labels)
    for more, expected in (((3, 8), {1: 1, 2: 1, 3: 1, 7: 1, 8: 1}), ((4, 5), {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 4: 4, 5: 4}), ((3, 0), {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7})):
        got = jaccard.joined_links(links, of([more]), labels)[1]
        assert {r["node"]: r["label"] for r in got.collect()} == expected


def test_only_sets_that_pairs_need_are_dealt_out(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(2000)]
    texts += [t + " more" for t in texts[:3]] + texts[:3]  # near copies and copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = common.cut(jaccard.scan(docs))
    classes = scanned.groupBy("name").agg({"id": "min"}).toDF("name", "id").localCheckpoint()
    sets = common.cut(jaccard.fetched_sets(docs, classes))
    assert sets.count() == sets.select("name", "fragment").distinct().count() == jaccard.FRAGMENTS * 2003
    name = {r.id: r.name for r in scanned.collect()}
    links = [tuple(sorted((name[i], name[2000 + i]))) for i in range(3)]
    pairs = common.cut(spark.createDataFrame([*links, tuple(sorted((name[5], name[6])))], "a long, b long"))
    for key in ("a", "b"):
        dealt = {r.name for r in jaccard.named(sets, pairs, key).select("name").collect()}
        assert {r[key] for r in pairs.collect()} <= dealt and len(dealt) < 100
    assert sorted((r.a, r.b) for r in jaccard.verified(pairs, sets).collect()) == sorted(links)
    few = common.cut(classes.where("id < 50"))
    got = {r.name for r in jaccard.fetched_sets(docs, few).collect()}
    assert {name[i] for i in range(50)} <= got and len(got) < 200


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    def train(texts, labels, totals):
        import os

        import numpy as np

        from tessera.llm import toxicity

        return toxicity.Model(np.full(4, len(texts), np.float32), np.array([labels.sum()], float), float(os.getpid()))

    monkeypatch.setattr(toxicity, "train", train)
    docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    training = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert model.weights.tolist() == [len(training)] * 4 and model.slopes.tolist() == [sum(i % 2 for i in training)]
    assert model.offset != os.getpid()  # not in the driver
    monkeypatch.undo()
    assert toxicity.fit_toxicity(docs.limit(0), labels).scores([b"text"]).shape == (1,)


def test_narrow_tables_of_the_join_take_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        keys = spark.range(500).withColumnRenamed("id", "key")
        bits = membership.bitmap(keys, "key")
        assert bits.rows.rdd.getNumPartitions() <= common.LEAST_TASKS
        assert membership.maybe(keys, "key", bits).where("__maybe").count() == 500
        members = spark.createDataFrame([(g, c, 9, 3, 1) for g in range(4) for c in range(g, g + 9)], "gram long, name long, n long, lists long, spare long")
        weights = members.groupBy("name").agg({"gram": "count"}).withColumnRenamed("count(gram)", "lists").selectExpr("name", "lists", "lists as shared")
        span = jaccard.open_to_links(members.select("gram", "name", "n"), weights, 36)
        assert {(r.gram, r.name) for r in span.collect()} == {(g, c) for g in range(4) for c in range(g, g + 9)}
        pairs = jaccard.hub_pairs(jaccard.labelled(members, None, 36), 1, 1, 36)
        assert {(r.a, r.b) for r in pairs.collect()} >= {(0, 1), (0, 2)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
