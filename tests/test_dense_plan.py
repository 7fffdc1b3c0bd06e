"""Recall by meaning, and retrieval with it."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense_index
from tessera.plans.dense import Index, indexed_blocks, recalled, retrieved_by_meaning
from tessera.plans.retrieve import Options, retrieved
from tessera.plans.shape_queries import letter_counts

TEXTS = {"a.rs": "zebra line\nzzz zz\n", "b.rs": "apple\nbanana\n", "c.py": "def q():\n    zz = 1\n    return zz\n\nx = 1\n", "d.rs": "zzz zz\nzebra line\n", "e.png": "zzz", "build/f.rs": "zzz", "g.rs": "", "dup.rs": "zzz zz\nzebra line\n"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, i, t, len(t), t.count("\n") + 1) for i, (p, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "path string, doc_id long, text string, bytes long, line_count int").repartition(5)


def test_ties_go_by_path_and_line(files):
    index = Index(letter_counts, keep=2)
    rows = recalled(files, "zzzzz zebra line", index).orderBy("rank").collect()
    assert [(r.path, r.start_line, r.rank) for r in rows] == [("a.rs", 1, 1), ("d.rs", 1, 2)]
    assert rows[0].similarity == rows[1].similarity


def test_blocks_of_the_index(files):
    assert {r.path for r in indexed_blocks(files, Index(letter_counts)).collect()} == {"a.rs", "b.rs", "c.py", "d.rs", "dup.rs"}
    assert {r.path for r in indexed_blocks(files, Index(letter_counts, max_files=2)).collect()} == {"a.rs", "b.rs"}
    assert {r.path for r in indexed_blocks(files, Index(letter_counts, max_blocks=1)).collect()} == {"a.rs"}
    every = indexed_blocks(files, Index(letter_counts, max_files=None, max_blocks=None))
    assert every.count() == 5
    by_definition = indexed_blocks(files, Index(letter_counts, max_files=None, max_blocks=None), Options(by_definition=True))
    assert [(r.start_line, r.end_line) for r in by_definition.where("path = 'c.py'").collect()] == [(1, 3)]
    assert tuple(dense_index.left_out(files, every).first()) == (8, 5, 3)


def test_what_words_miss_comes_in_by_meaning(spark):
    texts = {"a.rs": "needle apple\n" + "needle\n" * 3, "b.rs": "needle pear\n", "z.rs": "zzzz zzzz\n"}
    files = spark.createDataFrame([(p, i, t, len(t), t.count("\n") + 1) for i, (p, t) in enumerate(texts.items())], "path string, doc_id long, text string, bytes long, line_count int")
    embed = lambda given: [[float("zzz" in t or "needle" == t), 1e-3] for t in given]
    alone = retrieved(files, "needle", Options())
    assert {r.path for r in alone.chunks.collect()} == {"a.rs", "b.rs"}
    both = retrieved_by_meaning(files, "needle", Index(embed), Options(min_score_percent=0))
    assert {r.path for r in both.chunks.collect()} == {"a.rs", "b.rs", "z.rs"}
    assert {r.path for r in both.documents.collect()} == {"a.rs", "b.rs", "z.rs"}
    none = retrieved_by_meaning(files, "zebra", Index(embed, keep=1), Options(min_score_percent=0))
    assert {r.path for r in none.chunks.collect()} <= set(texts)


def test_recalled_files_are_read_once(spark, files):
    two = files.where("path in ('a.rs', 'b.rs')")
    more = files.where(F.col("path").isin("b.rs", "c.py"))
    assert sorted(r.path for r in dense_index.with_recalled(two, more).collect()) == ["a.rs", "b.rs", "c.py"]
