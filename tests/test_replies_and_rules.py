"""Lenient replies, ignore files by folder, and texts of untracked files."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import shell_quoted
from tessera.operators import assist, replies
from tessera.plans.queries import ORACLES, QUERIES
from tessera.sources import ignore
from tessera.sources.files import untracked_changes

GOOD = {"path": "a.rs", "startLine": 1, "endLine": 2, "summary": "s"}
REPLIES = [
    ({"answer": "x", "findings": [GOOD, {**GOOD, "path": "b.rs"}], "uncertainties": ["u", 7, None, {"k": [1]}]}, None),
    ({"answer": "x", "findings": GOOD, "uncertainties": "one", "more": 1}, None),
    ({"answer": "x", "findings": None, "uncertainties": None}, None),
    ({}, None),
    ({"findings": [{**GOOD, "severity": None}, {**GOOD, "severity": "high", "extra": 1}]}, None),
    ({"answer": None}, "model returned invalid JSON"),
    ({"answer": 3}, "model returned invalid JSON"),
    ({"findings": [{"path": "a.rs"}]}, "model returned invalid JSON"),
    ({"findings": [{**GOOD, "startLine": -1}]}, "model returned invalid JSON"),
    ({"findings": [{**GOOD, "startLine": 1.5}]}, "model returned invalid JSON"),
    ({"findings": ["a.rs"]}, "model returned invalid JSON"),
    ({"findings": [{**GOOD, "severity": 2}]}, "model returned invalid JSON"),
    ("{", "model returned invalid JSON"),
    (None, "model returned invalid JSON"),
    ("text", "model returned invalid JSON"),
    ([1], "model returned invalid JSON"),
    ({"answer": "x" * 16_000}, None),
    ({"answer": "😀" * 8_001}, "model response field answer exceeds 16000 characters"),
    ({"findings": [GOOD] * 101}, "model response contains too many items"),
    ({"findings": [GOOD] * 100, "uncertainties": ["u"] * 50}, None),
    ({"uncertainties": ["u"] * 51}, "model response contains too many items"),
    ({"uncertainties": ["u", "x" * 2001]}, "model response field uncertainties[1] exceeds 2000 characters"),
    ({"findings": [{**GOOD, "path": "b.rs"}, {**GOOD, "endLine": 99}]}, "all findings were dropped: unknown_path, outside_evidence"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "reply_id long, content string")


def test_replies(spark):
    given = table(spark, [r for r, _ in REPLIES])
    excerpts = given.select("reply_id", F.lit("a.rs").alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))
    rows = {r.reply_id: r for r in replies.grounded_replies(given, excerpts).collect()}
    assert [rows[i].error for i in range(len(REPLIES))] == [e for _, e in REPLIES]
    assert rows[0].uncertainties == ["u", "7", "null", '{"k":[1]}'] and rows[1].uncertainties == ["one"] and rows[2].uncertainties == rows[3].uncertainties == []
    assert [f.verify_hint for f in rows[0].findings] == ["sed -n '1,2p' a.rs"] and [(f.path, f.reason) for f in rows[0].dropped_findings] == [("b.rs", "unknown_path")]
    assert len(rows[1].findings) == 1 and rows[3].findings == [] and [f.severity for f in rows[4].findings] == [None, "high"]
    assert rows[12].answer is None and rows[12].findings is None and rows[22].findings is None and len(rows[19].findings) == 100
    assert replies.grounded_replies(given.limit(0), excerpts).collect() == []


def test_each_reply_has_its_own_excerpts(spark):
    given = table(spark, [{"findings": [GOOD]}] * 2)
    excerpts = spark.createDataFrame([(0, "a.rs", 1, 3), (1, "c.rs", 1, 3)], "reply_id long, path string, start_line int, end_line int")
    assert {r.reply_id: r.error for r in replies.grounded_replies(given, excerpts).collect()} == {0: None, 1: "all findings were dropped: unknown_path"}


def test_scores_and_terms(spark):
    rows = [{"scores": [0.5, 2, -1]}, [1, 0, 0.25], {"scores": [1, 2]}, {"scores": [1, "x", 2]}, "no", {"scores": 3}, [None, 1, 1], None]
    got = {r.reply_id: r.scores for r in replies.score_replies(table(spark, rows).withColumn("expected", F.lit(3))).collect()}
    assert [got[i] for i in range(8)] == [[0.5, 1.0, 0.0], [1.0, 0.0, 0.25], None, None, None, None, None, None]
    rows = [{"terms": ["Ab", "ab", "x", "a b", "ok", 7, "y" * 65]}, ["one", "two"], {"terms": "one"}, "{", [f"t{i}" for i in range(12)], None, {}]
    got = {r.reply_id: r.terms for r in replies.expansion_replies(table(spark, rows)).collect()}
    assert [got[i] for i in range(7)] == [["Ab", "ok"], ["one", "two"], [], [], [f"t{i}" for i in range(8)], [], []]
    assert [got[i] for i in range(5)] == [assist.expansion_terms(r if isinstance(r, str) else json.dumps(r)) for r in rows[:5]]


IGNORES = {
    ".gitignore": "# c\n\n*.log\n/build\nout/\n!keep.log\nsrc/**/gen\ndoc?.md\n[ab]x.txt\n\\#odd\nsp ace  \n",
    "src/.gitignore": "!debug.log\n*.tmp\n/top.rs\n",
    "src/a/.gitignore": "debug.log\n!x.tmp\n",
    "src/a/.ignore": "only.rs\n",
}
PATHS = {
    "a.log": False, "keep.log": True, "x/keep.log": True, "build": False, "build/x.rs": False, "x/build/y.rs": True, "out": True, "out/x.rs": False, "x/out/y.rs": False,
    "src/debug.log": True, "src/a/debug.log": False, "src/b/debug.log": True, "src/o.tmp": False, "src/a/x.tmp": True, "src/a/y.tmp": False, "o.tmp": True,
    "src/top.rs": False, "src/a/top.rs": True, "src/gen/z.rs": False, "src/p/q/gen/z.rs": False, "gen/z.rs": True, "doc1.md": False, "doc12.md": True, "ax.txt": False, "cx.txt": True,
    "#odd": False, "sp ace": False, ".env": False, ".h/x.rs": False, "src/a/only.rs": False, "src/only.rs": True, "build/keep.log": False, "a.b.log/c": False,
}


def test_rules_of_every_folder(spark):
    files = spark.createDataFrame([*IGNORES.items(), *((p, "x") for p in PATHS), ("keep.log", "again")], "path string, text string")
    got = [r.path for r in ignore.visible_files(files, ignore.ignore_rules(files)).collect()]
    assert sorted(got) == sorted([p for p, seen in PATHS.items() if seen] + ["keep.log"])
    none = ignore.ignore_rules(files.limit(0))
    assert ignore.visible_files(files.where("path = 'a.log'"), none).count() == 1 and ignore.visible_files(files.limit(0), none).count() == 0


def test_texts_of_untracked_files(spark):
    contents = {"ok": "é".encode(), "cut": b"a" * 63_999 + "é".encode(), "raw": b"\xff\x00", "empty": b"", "none": None, "long": b"b" * 70_000}
    rows = untracked_changes(spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content binary"))
    assert {r.path: r.text for r in rows.collect()} == {"ok": "é", "cut": "", "raw": "", "empty": "", "none": "", "long": "b" * 64_000}


@pytest.mark.parametrize("path, quoted", [("a/b-c.rs", "a/b-c.rs"), ("-x", "'-x'"), ("a b", "'a b'"), ("é.rs", "é.rs"), ("it's", "'it'\\''s'"), ("", "''")])
def test_paths_for_a_shell(spark, path, quoted):
    assert spark.createDataFrame([(path,)], "p string").select(shell_quoted(F.col("p"))).first()[0] == quoted


def test_all_changes_has_whole_texts(spark, tmp_path):
    """Untracked texts over the bound that other callers have, one cut inside a character by it, and null."""
    long = ["x" * 70_000, "ü" * 40_001, "a" + "ü" * 40_000, "", None]
    rows = [(i, t, "en", f"src{i % 2 + 1}") for i, t in enumerate(long)] + [(9, "ü" * 40_001, "fr", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r[c] for c in ("path", "whole_file", "start_line", "end_line", "text")) for r in QUERIES["all_changes"](spark, str(tmp_path)).collect()]
    want = con.execute(f"SELECT path, whole_file, start_line, end_line, text FROM ({ORACLES['all_changes']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
