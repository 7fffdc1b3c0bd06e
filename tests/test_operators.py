"""Operators on small literal inputs."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import terms
from tessera.functions import text as T
from tessera.operators import assembly, assist, chunks, dense, dense_index, evaluation, feedback, lexical, structure
from tessera.plans import retrieve
from tessera.sources.files import glob_filter, read_text_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms():
    assert terms.query_terms("IO db S3 v2 is of") == ["IO", "S3", "v2"]
    assert [terms.stem(t) for t in "paths classes status focus basis submitted checked".split()] == ["path", "class", "status", "focus", "basis", "submit", "check"]
    assert terms.split_words("HTTPServer") == ["HTTP", "Server"]
    assert terms.split_words("v2Router") == ["v2", "Router"]
    assert terms.query_terms("cómo está donde") == []


def test_coverage_weight(spark):
    assert one(spark, T.coverage_weight(F.lit(15), F.array(*[F.lit(x) for x in (20, 3, 3, 3)]))) == 23


def test_boundaries(spark):
    rows = spark.createDataFrame([("constable",), ("comfortable",), ("table_name",), ("a table",)], "line string")
    assert [r[0] for r in rows.where(T.term_match(F.col("line"), ["table"])).collect()] == ["table_name", "a table"]


def test_tokens_and_quotes(spark):
    assert one(spark, T.estimate_tokens(F.lit("hello wor\nld !!!"))) == 2 + 1 + 1 + 2
    assert one(spark, T.verify_hint(F.lit("it's.rs"), F.lit(1), F.lit(2))) == "sed -n '1,2p' 'it'\\''s.rs'"
    assert one(spark, T.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_globs(spark):
    rows = spark.createDataFrame([("a/b.py",), ("a/b.md",), ("node_modules/x.js",), ("x/target/y.rs",), ("go.sum",)], "path string")
    assert [r[0] for r in rows.where(glob_filter(F.col("path"))).collect()] == ["a/b.py", "a/b.md"]
    assert [r[0] for r in rows.where(glob_filter(F.col("path"), ["a/**", "!*.md"])).collect()] == ["a/b.py"]


def test_cliff(spark):
    files = spark.createDataFrame([("t", 100), ("s1", 20), ("s2", 18), ("s3", 16), ("s4", 14)], "path string, score long")
    assert [r["path"] for r in lexical.concentration_cliff(files).orderBy("rn").collect()] == ["t", "s1", "s2"]


def test_floor(spark):
    rows = spark.createDataFrame([(0, 100), (0, 78), (0, 55), (0, 30), (0, 13)], "query_id long, score long")
    assert chunks.relevance_floor(rows).count() == 4


def test_packing_order():
    rows = pd.DataFrame([("head", 1, 100, 60, []), ("target", 1, 90, 60, []), ("target", 50, 85, 30, []), ("other", 1, 80, 30, []), ("tail", 1, 10, 10, [])], columns=["path", "start_line", "score", "estimated_tokens", "words"])
    out = chunks.greedy_pack(rows, 100)
    assert [(r.path, r.estimated_tokens) for r in out.itertuples()] == [("head", 60), ("target", 30), ("tail", 10)]


def test_near_duplicates_are_not_both_packed():
    rows = pd.DataFrame([("a", 1, 10, 60, ["x", "y"]), ("b", 1, 9, 60, ["x", "y"]), ("c", 1, 8, 60, ["z"])], columns=["path", "start_line", "score", "estimated_tokens", "words"])
    assert list(chunks.greedy_pack(rows, 130)["path"]) == ["a", "c"]


BLOCKS = [
    ("body of a function", ["fn outer() {", "    let a = 1;", "    let b = 2;", "    call(a, b);", "}", "fn other() {}", ""], 4, (1, 4)),
    ("no header", ["use one;", "use two;", ""], 1, None),
    ("too long", ["fn big() {", *["    let v = 1;"] * 60, "}", ""], 30, None),
    ("brace on its own line", ["int foo(int x)", "{", "    return x;", "}", ""], 3, (1, 3)),
    ("signature over lines", ["fn foo(", "    a: i32,", ") -> T {", "    body(a);", "}", ""], 4, (1, 4)),
    ("decorator", ['@app.route("/")', "def handler():", "    return ok()", ""], 3, (1, 3)),
    ("attribute and comment", ["/// Does it.", "#[test]", "fn checks() {", "    assert!(work());", "}", ""], 4, (1, 4)),
    ("not across a blank line", ["let unrelated = 1;", "", "def handler():", "    return ok()", ""], 4, (3, 4)),
    ("blank lines inside, none at the end", ["import x", "", "@note", "def f():", "    a", "", "    b", "", "c"], 5, (3, 7)),
    ("notes at another indent stay out", ["class A:", "        # far", "    def f():", "        x", "    y"], 4, (3, 4)),
    ("blank line", ["a", "", "b"], 2, None),
]


def test_blocks(spark):
    lines = spark.createDataFrame([(name, i + 1, t) for name, text, _, _ in BLOCKS for i, t in enumerate(text)], "path string, line_no int, line string")
    hits = spark.createDataFrame([(name, at) for name, _, at, _ in BLOCKS], "path string, line_no int")
    found = {r["path"]: (r["start_line"], r["end_line"]) for r in structure.enclosing_block(lines, hits).collect()}
    assert found == {name: want or (None, None) for name, _, _, want in BLOCKS}


def test_ranges_of_a_file():
    trivial = [False, True, False, False, True, True]
    whole = chunks.file_ranges([10] * 6, 5, trivial, [(3, 1, 7), (4, 2, 9)], {}, 1000, 8)
    assert whole == [(1, 4, 9, 3)]  # trivial ends go before the cost is taken
    assert chunks.file_ranges([10] * 6, 5, trivial, [(4, 1, 7)], {}, 25, 8) == [(3, 4, 7, 1)]  # lines 2 to 6 cost 55, without their ends 25
    assert chunks.file_ranges([10] * 6, 5, trivial, [(4, 1, 7)], {4: (1, 6)}, 45, 0) == [(1, 4, 7, 1)]
    assert chunks.file_ranges([10] * 6, 5, trivial, [(1, 1, 7), (3, 1, 5)], {}, 15, 0) == [(1, 1, 7, 1), (3, 3, 5, 1)]


def test_targeted_reads_and_drift(spark):
    files = spark.createDataFrame([("a", "\n".join(f"w{i}" for i in range(30))), ("b", "x\n}\ny")], "path string, text string")
    ranked = spark.createDataFrame([(0, 1, "a", 5), (0, 2, "a", 8), (0, 3, "b", 2), (0, 4, "a", 25), (0, 5, "a", 99)], "query_id long, position int, path string, line_no int")
    got = assembly.targeted_reads(ranked, files, budget=1000, context=2).orderBy("position").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [("a", 3, 7), ("b", 1, 3), ("a", 23, 27)]  # the second meets the first
    first = got[0]["tokens"]
    few = assembly.targeted_reads(ranked, files, budget=first + 1, context=2).collect()
    assert [r["position"] for r in few] == [1]  # the others no longer fit
    rows = spark.createDataFrame([("a", "1: x", 44), ("a", "1: x", 99)], "path string, content string, estimated_tokens long")
    assert [r["estimated_tokens"] for r in assembly.token_drift(rows).collect()] == [99]


def test_dense_index(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "\n".join(["x"] * 90)), ("b.py", "\n\n"), ("c.png", "x"), ("d.py", "y")], "path string, text string").withColumn("doc_id", F.lit(1))
    blocks = dense_index.index_blocks(dense_index.listed_files(files))
    assert sorted((r["path"], r["start_line"], r["end_line"]) for r in blocks.collect()) == [("a.py", 1, 80), ("a.py", 81, 90), ("d.py", 1, 1)]
    assert dense_index.index_blocks(files, most=1).select("path").distinct().count() == 1
    embed = lambda texts: [[float(len(t)), float("y" in t)] for t in texts]
    cache = str(tmp_path / "vectors")
    for _ in range(2):
        vectors = dense_index.with_vectors(blocks, embed, "m", cache)
        assert vectors.count() == 3
    assert spark.read.parquet(cache).count() == 3  # the second time nothing is embedded
    hits = dense_index.recall(vectors, [0.0, 1.0], 2).orderBy("rank").collect()
    assert hits[0]["path"] == "d.py" and len(hits) == 2


def test_retrieval_options(spark):
    text = ["def parse_config(path):", "    value = read_settings(path)", "    return value", "", "def other():", "    return 1"]
    files = spark.createDataFrame([("src/a.py", 1, "\n".join(text)), ("src/b.py", 2, "settings = 1\nnothing here"), ("src/c.py", 3, "unrelated text\nof words")], "path string, doc_id long, text string")
    files = files.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("line_count", F.size(F.split("text", "\n")))
    out = retrieve.retrieved(files, "where are settings read for parse_config", retrieve.Options(why=True))
    rows = out.chunks.orderBy("position").collect()
    assert rows[0]["path"] == "src/a.py" and "parse_config" in rows[0]["matched_terms"] and rows[0]["source"] == "lexical"
    total = out.summary.first()
    assert total["chunks"] == len(rows) and total["estimated_tokens"] == sum(r["estimated_tokens"] for r in rows) and total["truncated"] == (total["chunks"] < 2)
    documents = {r["path"]: r for r in out.documents.collect()}
    assert documents["src/a.py"]["bytes"] == sum(len(r["content"]) for r in rows if r["path"] == "src/a.py")
    dense_hits = spark.createDataFrame([(0, "src/c.py", 1, 2, 0.9)], "query_id long, path string, start_line int, end_line int, similarity double")
    fused = retrieve.retrieved(files, "where are settings read for parse_config", retrieve.Options(why=True, min_score_percent=0), dense_hits=dense_hits).chunks.collect()
    assert {r["source"] for r in fused if r["path"] == "src/c.py"} == {"dense"}
    untracked = retrieve.retrieved(files, "settings", untracked=files.where("path = 'src/b.py'")).chunks.orderBy("position").first()
    assert untracked["path"] == "src/b.py"
    change = retrieve.Change(files.where("path = 'src/b.py'").select("path", F.lit(True).alias("whole_file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")), ("src/b.py",), "settings = 1")
    scoped = retrieve.retrieved(files, "what else", change=change, options=retrieve.Options(globs=("!src/b.py",))).chunks.collect()
    assert {r["path"] for r in scoped} == {"src/b.py"}  # the scope wins over the caller's exclusions


def test_weak_evidence(spark):
    hits = spark.createDataFrame([(1, 7), (5, 3)], "line_no int, mask int")
    assert feedback.evidence_is_weak(hits, 4) and not feedback.evidence_is_weak(hits.withColumn("line_no", F.lit(2)), 4) and feedback.evidence_is_weak(hits.withColumn("line_no", F.lit(2)), 7)


def test_rerank(spark):
    rows = spark.createDataFrame([(0, "a", 1, 30), (0, "b", 1, 20), (0, "c", 1, 10)], "query_id long, path string, start_line int, score long")
    opinions = spark.createDataFrame([(0, "a", 1, 0.1), (0, "b", 1, 0.2), (0, "c", 1, 0.9)], "query_id long, path string, start_line int, opinion double")
    out = chunks.rerank(rows, opinions).orderBy(F.desc("score")).collect()
    assert [r["path"] for r in out] == ["c", "b", "a"]


def test_replies():
    assert assist.expansion_terms('{"terms": ["Ab", "ab", "x", "two words", "cd"]}') == ["Ab", "cd"]
    assert assist.expansion_terms("nonsense") == []
    assert assist.reply_scores("[2, -1, 0.5]", 3) == [1.0, 0.0, 0.5]
    reply, fell_back = assist.first_that_works(["m1", "m2"], lambda m: m, lambda r: {"r": r} if r == "m2" else 1 / 0)
    assert reply == {"r": "m2"} and fell_back


def test_dense_gate(spark):
    chunk = spark.createDataFrame([(0, "a", 1, 9, 50), (0, "b", 1, 9, 40)], "query_id long, path string, start_line int, end_line int, score long")
    near = spark.createDataFrame([(0, "x", 1, 9, 0.80), (0, "y", 1, 9, 0.79)], "query_id long, path string, start_line int, end_line int, similarity double")
    clear = near.withColumn("similarity", F.when(F.col("path") == "x", 0.82).otherwise(0.78))
    assert dense.dense_fusion(chunk, near).count() == 2
    more = spark.createDataFrame([(0, "a", 1, 9, 50), (0, "a", 20, 29, 45), (0, "b", 1, 9, 40)], chunk.schema)
    assert dense.dense_fusion(more, clear).where("path = 'x'").first()["score"] == 45  # the second candidate, not the second file
    assert dense.dense_fusion(chunk, clear.withColumn("line_count", F.lit(8))).where("path = 'x'").count() == 0
    assert dense.dense_fusion(chunk, clear.withColumn("estimated_tokens", F.lit(9)), 8).where("path = 'x'").count() == 0
    assert dense.dense_fusion(chunk, clear).where("path = 'x'").first()["score"] == 40


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: round(r["similarity"], 6) for r in dense.dense_topk(rows, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_gates():
    assert evaluation.gate_failures({"hit@5": 0.8, "mrr": 0.4, "avg_tokens": 1000}, {"hit@5": 0.75, "mrr": 0.45, "avg_tokens": 1200}) == ["mrr: 0.4 against 0.45"]


def test_folder_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "src" / "nul.txt").write_bytes(b"a\0b")
    (tmp_path / "src" / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "src" / "x.png").write_bytes(b"plain")
    rows = read_text_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["lines"]) for r in rows] == [("src/a.py", ["one", "two", ""])]
