"""Scans of named files, and evaluation of labelled corpora."""

import json

import pytest

from tessera.plans import evaluate
from tessera.plans.retrieve import Options
from tessera.plans.scan import FallbackExhausted, Reply, attempt_ms, dry_run, merged, scan
from tests.test_repository import git, write

GOOD = json.dumps({"answer": "yes", "findings": [{"path": "a.rs", "startLine": 1, "endLine": 2, "summary": "s"}, {"path": "gone.rs", "startLine": 1, "endLine": 1, "summary": "s"}], "uncertainties": "maybe"})


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, {"a.rs": "fn a() {}\nfn b() {}\n", "src/b.py": "x = 1\n"})
    return str(tmp_path)


def test_a_scan_is_grounded(spark, tree):
    seen = []

    def ask(model, question, documents, ms):
        seen.append((model, question, [d.path for d in documents], documents[0].numbered_content, ms))
        return Reply(GOOD, {"total_tokens": 5}, "m1-exact")

    got = scan(spark, tree, ["src/b.py", "a.rs"], " what? ", ask, ["m1"])
    assert (got.answer, got.model, got.fallback, got.usage, got.files_read) == ("yes", "m1-exact", False, {"total_tokens": 5}, ["a.rs", "src/b.py"])
    assert [f.verify_hint for f in got.findings] == ["sed -n '1,2p' a.rs"] and [f.reason for f in got.dropped_findings] == ["unknown_path"] and got.uncertainties == ["maybe"]
    assert seen[0][:4] == ("m1", "what?", ["a.rs", "src/b.py"], "1: fn a() {}\n2: fn b() {}\n3: ") and 0 < seen[0][4] <= 60_000


def test_the_next_model_and_all_usage(spark, tree):
    replies = {"m1": Reply("{", {"total_tokens": 5, "cost": 0.5}), "m2": Reply(json.dumps({"findings": [{"path": "no", "startLine": 1, "endLine": 1, "summary": ""}]}), {"total_tokens": 2}), "m3": Reply(GOOD)}
    got = scan(spark, tree, ["a.rs"], "what?", lambda m, *_: replies[m], ["m1", " ", "m2", "m3"])
    assert (got.model, got.fallback, got.usage) == ("m3", True, {"total_tokens": 7, "cost": 0.5})
    with pytest.raises(FallbackExhausted, match="fallback exhausted: m1: model returned invalid JSON; m2: all findings were dropped: unknown_path; m4: ") as failed:
        scan(spark, tree, ["a.rs"], "what?", lambda m, *_: replies[m], ["m1", "m2", "m4"])
    assert failed.value.usage == {"total_tokens": 7, "cost": 0.5}
    with pytest.raises(FallbackExhausted, match="deadline"):
        scan(spark, tree, ["a.rs"], "what?", lambda m, *_: Reply(GOOD), ["m1"], timeout_ms=0)


def test_times_and_usage():
    assert [attempt_ms(60_000, n) for n in (0, 1, 2, 3)] == [60_000, 40_000, 20_000, 5_000] and attempt_ms(900, 2) == 900
    assert merged(None, None) is None and merged({"cost": 1.0}, None) == {"cost": 1.0} and merged({"cost": 1.0}, {"total_tokens": 2}) == {"cost": 1.0, "total_tokens": 2}


def test_a_dry_run(spark, tree):
    assert dry_run(spark, tree, ["a.rs", "src/b.py", "a.rs"], "q", " m ") == {"version": 1, "dry_run": True, "model": "m", "files_read": ["a.rs", "src/b.py"], "total_bytes": 26}
    for question, message in (("  ", "empty"), ("x" * 16_001, "exceeds")):
        with pytest.raises(ValueError, match=message):
            dry_run(spark, tree, ["a.rs"], question, "m")
    with pytest.raises(ValueError):
        Options(budget_tokens=1_000_001)


CORPUS = {
    "version": 1, "name": "n", "budgetTokens": 600, "contextLines": 2, "maxHits": 20, "globs": ["!docs/**"], "ks": [1, 3], "strategies": ["lexical", "prf"],
    "cases": [
        {"id": "one", "question": "parse widget header", "expected": [{"path": "src/widget.rs", "startLine": 1, "endLine": 3}]},
        {"id": "two", "question": "socket timeout", "expected": [{"path": "nowhere.rs"}, {"path": "src/socket.rs"}]},
        {"id": "three", "question": "missing thing", "expected": [{"path": "src/socket.rs", "startLine": 90, "endLine": 99}]},
    ],
    "gates": {"lexical": {"hitAt": {"1": 0.6, "3": 0.7}, "minMrr": 0.5, "maxAvgTokens": 1}},
}


def test_a_corpus_is_evaluated(spark):
    texts = {"src/widget.rs": "fn parse_header() {\n    widget();\n}\n", "src/socket.rs": "fn socket() {\n    timeout();\n}\n", "docs/widget.md": "parse widget header\n", "src/other.rs": "fn thing() {}\n"}
    files = spark.createDataFrame([(p, i, t, len(t), t.count("\n") + 1) for i, (p, t) in enumerate(texts.items())], "path string, doc_id long, text string, bytes long, line_count int")
    (lexical,) = evaluate.evaluate_corpus(files, evaluate.read_corpus(json.dumps(CORPUS | {"strategies": ["lexical"]})))
    (prf,) = evaluate.evaluate_corpus(files, evaluate.read_corpus(json.dumps(CORPUS | {"strategies": ["prf"], "cases": CORPUS["cases"][:1]})))
    assert {r.id: r.first_relevant_rank for r in lexical.cases.collect()} == {"one": 1, "two": 1, "three": None}
    assert lexical.totals["hit@1"] == lexical.totals["hit@3"] == lexical.totals["mrr"] == pytest.approx(0.666667)
    assert [f.split(":")[0] for f in lexical.failures] == ["hit@3", "avg_tokens"] and prf.failures == []
    assert prf.totals["mrr"] == 1.0 and prf.strategy == "prf"


@pytest.mark.parametrize("change, message", [({"version": 2}, "version"), ({"cases": []}, "no cases"), ({"strategies": []}, "no strategies"), ({"ks": [0]}, "ks"), ({"maxHits": 0}, "positive"), ({"repository": {"url": " ", "commit": "0" * 40}}, "url"), ({"repository": {"url": "u", "commit": "abc"}}, "40-character"), ({"cases": [{"id": " ", "question": "q"}]}, "must not be empty"), ({"cases": [{"id": "a", "question": "q"}]}, "no expected"), ({"cases": [{"id": "a", "question": "q", "expected": [{"path": " "}]}]}, "empty expected path"), ({"cases": [{"id": "a", "question": "q", "expected": [{"path": "p", "startLine": 3, "endLine": 2}]}]}, "valid order"), ({"cases": [{"id": "a", "question": "q", "expected": [{"path": "p", "startLine": 3}]}]}, "valid order")])
def test_what_a_corpus_must_hold(change, message):
    with pytest.raises(ValueError, match=message):
        evaluate.read_corpus(json.dumps(CORPUS | change))


def test_a_pinned_repository(tmp_path):
    write(tmp_path, {"r/a.rs": "a"})
    git(tmp_path / "r", "init")
    git(tmp_path / "r", "add", "-A")
    git(tmp_path / "r", "commit", "-m", "x")
    head = evaluate.git(str(tmp_path / "r"), "rev-parse", "HEAD").decode().strip()
    evaluate.verify_pin(str(tmp_path / "r"), head.upper())
    with pytest.raises(ValueError, match="mismatch"):
        evaluate.verify_pin(str(tmp_path / "r"), "0" * 40)
    write(tmp_path, {"r/b.rs": "b"})
    with pytest.raises(ValueError, match="dirty"):
        evaluate.verify_pin(str(tmp_path / "r"), head)
