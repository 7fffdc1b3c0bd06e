"""Batches of questions give what each question gives alone."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.terms import intrinsic_weights, query_terms, term_forms
from tessera.functions.text import term_match
from tessera.operators import batch, corpus, evaluation, lexical
from tessera.plans import batch_queries
from tessera.plans.batch import batch_ranked, evaluate_batch, retrieve_batch
from tessera.plans.retrieve import Options, retrieve
from tessera.sources import carriers

TEXTS = {
    "src/auth_token/verify.rs": "fn verify_token(t: &Token) {\n    let claims = t.claims();\n    check(claims)\n}\n\nfn other() {}\n",
    "src/http/server.py": "class HTTPServer:\n    def handle(self):\n        return verifyToken(1)\n\n    def stop(self): pass\n",
    "docs/README.md": "Verify the token.\nTOKENS are verified\nſtop ΣΑΣ here\n",
    "package.json": '{"name": "verify-token", "token": 1}\n',
    "src/empty.txt": "",
    "lib/verifying.rs": "i̇x İx\npub mod a;\n// re-verify-token/x.y:z\nnot_a_claims_thing\nunclaimed\n",
}
QUESTIONS = ["Where does verifyToken check claims?", "how to stop HTTPServer v2 in src", "the of and", "", None, "claims claims Claimed claim's", "STOP σας İx", "re-verify-token x.y:z", "nothingmatches"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, i, t, len(t.encode()), t.count("\n") + 1) for i, (p, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "path string, doc_id long, text string, bytes long, line_count int")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, question string")


def test_terms_are_those_of_single_questions(spark, questions):
    odd = ["a.b/c-d:: ..x.. --yy--", "XY xy x9 9x ab", "running passed passes glass bus thesis fitted matted", "parseHTTPResponse snake_case_name kebab-case Foo::Bar a1B2 ABCd", "día años İstanbul ßtraße", " ".join(f"word{i}" for i in range(30)), "del the CÓMO Qué"]
    both = questions.union(spark.createDataFrame([(100 + i, q) for i, q in enumerate(odd)], "query_id long, question string"))
    got: dict[int, list] = {}
    for r in batch.question_terms(both).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append((r.term, r.forms, r.intrinsic))
    for r in both.collect():
        names = query_terms(r.question or "")
        want = [(t, term_forms(t), w) for t, w in zip(names, intrinsic_weights(names), strict=True)]
        assert got.get(r.query_id, []) == [(t, [f.replace("ς", "σ") for f in fs], w) for t, fs, w in want]


def test_hits_are_those_of_matching_by_pattern(spark, files, questions):
    lines, terms = carriers.lines(files), batch.question_terms(questions)
    got = {(r.query_id, r.path, r.line_no): r.mask for r in batch.batch_hits(terms, batch.postings(lines)).collect()}
    want = {}
    for i, q in enumerate(QUESTIONS):
        asked = lexical.Terms.of(q or "")
        if asked.names:
            for r in lines.select("path", "line_no", lexical.mask_of([term_match(F.col("line"), f) for f in asked.forms]).alias("mask")).where("mask <> 0").collect():
                want[i, r.path, r.line_no] = r.mask
    assert got == want


def test_ranking_is_that_of_single_questions(files, questions):
    options = Options(max_hits=4)
    got: dict[int, list] = {}
    for r in batch_ranked(files, questions, options).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.path, r.line_no, r.mask, r.score))
    for i, q in enumerate(QUESTIONS):
        terms = lexical.Terms.of(q or "")
        if not terms.names:
            assert i not in got
            continue
        hits = lexical.overfull_spread(lexical.search(files, carriers.lines(files), terms), 4)
        assert got.get(i, []) == [(r.path, r.line_no, r.mask, r.score) for r in lexical.diverse_hits(hits, 4).collect()]


def test_answers_are_those_of_single_questions(spark):
    data = "/root/testdata/sf0.001"
    files = carriers.files(spark, data)
    asked = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    options = Options(budget_tokens=900, max_hits=30)
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    columns = ("path", "start_line", "end_line", "score", "estimated_tokens", "content", "position")
    got = retrieve_batch(files, questions, options).collect()
    for i, q in enumerate(asked):
        want = [tuple(r[c] for c in columns) for r in retrieve(files, q, options).orderBy("position").collect()]
        assert sorted((tuple(r[c] for c in columns) for r in got if r.query_id == i), key=lambda r: r[-1]) == want


def test_empty_tables(spark, files, questions):
    assert batch_ranked(files.limit(0), questions).collect() == []
    assert batch_ranked(files, questions.limit(0)).collect() == []
    assert retrieve_batch(files, questions.where("query_id in (2, 3, 4)")).collect() == []


def test_expected_ranges_must_meet(spark):
    results = spark.createDataFrame([(1, "a", 1, 5, 1), (1, "a", 10, 20, 2), (2, "b", 1, 1, 3)], "query_id long, path string, start_line int, end_line int, position int")
    expected = spark.createDataFrame([(1, "a", 6, 10), (2, "b", None, None), (3, "c", 1, 2)], "query_id long, path string, start_line int, end_line int")
    report = evaluate_batch(results, expected)
    assert {r.query_id: r.rank for r in report.ranks.collect()} == {1: 2, 2: 3, 3: None}
    assert {r.k: r.hit_rate for r in report.hit_at_k.collect()} == {1: 0.0, 3: pytest.approx(0.666667), 5: pytest.approx(0.666667)}
    ranks = evaluation.first_ranks(results.withColumnRenamed("position", "rank").drop("start_line", "end_line"), expected)
    assert {r.query_id: r.rank for r in ranks.collect()} == {1: 1, 2: 3, 3: None}


def test_hits_are_found_where_files_are_read(spark, files, questions, monkeypatch):
    """Files of one path, lots of questions and small holds change nothing; and no hits are dealt out, as they are more than the corpus."""
    monkeypatch.setattr(corpus, "LOT", 20)
    monkeypatch.setattr(corpus, "HELD_ROWS", 3)
    monkeypatch.setattr(corpus, "SLICE_TOKENS", 5)
    more = files.select("path", (F.col("doc_id") + 50).alias("doc_id"), F.concat(F.lit("claims\nx\n"), "text").alias("text"), "bytes", "line_count").where("doc_id % 2 = 0")
    none = files.limit(1).select("path", "doc_id", F.lit(None).cast("string").alias("text"), "bytes", "line_count")
    both = files.union(more).union(none)
    lines, terms = carriers.lines(both), batch.question_terms(questions)
    table = lambda df, *c: sorted(tuple(r) for r in df.select("query_id", "path", "line_no", *c).collect())
    for per_file in (1, 2000):
        assert table(corpus.corpus_hits(both, terms, per_file), "mask") == table(batch.batch_hits(terms, batch.postings(lines), per_file), "mask")
        want = batch.batch_search(both, lines, terms, hits_per_file=per_file).persist()
        assert table(corpus.corpus_search(both, terms, per_file=per_file), "mask", "score") == table(want, "mask", "score")
    for limit in (1, 3):
        assert table(batch.batch_top(corpus.corpus_search(both, terms, limit), limit), "score", "position") == table(batch.batch_top(want, limit), "score", "position")
    plan = corpus.corpus_search(files, terms)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_lots_grow_with_the_questions_only(spark, monkeypatch):
    """A corpus with any number of words is read in as many lots as its questions' spellings need."""
    monkeypatch.setattr(corpus, "LOT", 100)
    files = spark.createDataFrame([("a.rs", "\n".join(f"claim{i} x.claims{i}" for i in range(300)))], "path string, text string")
    terms = batch.question_terms(spark.createDataFrame([(1, "claims")], "query_id long, question string"))
    assert len(list(corpus._lots(files, terms))) == 1
    assert corpus.corpus_hits(files, terms).count() == 300


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """A document of 2500 lines, and a question of more terms than a search of one question takes."""
    folder = str(tmp_path_factory.mktemp("long"))
    text = "\n".join(f"alpha {i}" for i in range(2500)) + "\nword0 word39"
    spark.createDataFrame([(1, text, "en", "web", len(text)), (2, "word39 word13 word35", "fr", "web", 20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta. " + " ".join(f"word{i}" for i in range(40)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_all_lines_of_long_files_are_hits(spark, long_tables):
    assert batch_queries.batch_hits(spark, long_tables).where("query_id = 1000").count() == 2500


def test_search_has_all_terms_and_lines(spark, long_tables):
    found = batch_queries.batch_search(spark, long_tables)
    assert found.where("query_id = 1000").count() == 2500
    assert {(r.path, r.line_no): r.mask for r in found.where("query_id = 1001").collect()} == {("web/doc_1.rs", 2501): "0,3,39", ("web/doc_2.py", 1): "1,3,13,35,39"}
