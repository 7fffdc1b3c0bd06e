"""Definitions of source code, and the tightest span around a line."""

import random

import pytest

from tessera.functions.definitions import definition_spans
from tessera.operators import definitions, structure
from tessera.plans.definition_queries import code_files
from tessera.sources import carriers

CASES = [
    ("a.rs", "/// Doc.\n#[inline]\nfn compute(x: i32) -> i32 {\n    let y = x + 1;\n    y * 2\n}\n", [(1, 6)]),
    ("a.py", '@app.route("/")\ndef handler():\n    return ok()\n', [(1, 3)]),
    ("a.go", "package main\n\nfunc Add(a int, b int) int {\n    sum := a + b\n    return sum\n}\n", [(3, 6)]),
    ("a.py", "class Widget:\n    def render(self):\n        return draw(self)\n", [(1, 3), (2, 3)]),
    ("a.zzz", "outer:\n    inner_call()\n", []),
    ("A.java", "package a;\n\n/** Doc */\npublic class A<T> extends B {\n  @Override\n  public int f(int x) throws E {\n    if (x > 0) {\n      return g(x);\n    }\n    for (int i = 0; i < 3; i++) { h(); }\n    return new X() { void z() { } }.q();\n  }\n  enum K { A, B }\n}\n", [(3, 14), (5, 12), (11, 11), (13, 13)]),
    ("x.ts", "export class A {\n  // note {\n  run(a: string): void {\n    const s = `x {`;\n    call(function () {\n      return 1;\n    });\n    if (a) { b(); }\n  }\n}\n\nconst f = (x) => {\n  return x;\n};\ninterface I {\n  a: string;\n}\n", [(1, 10), (2, 9), (5, 7), (12, 14), (15, 17)]),
    ("x.rs", "struct P(u32);\nstruct Q;\n\nimpl<'a> P<'a> {\n    // c '{'\n    fn a(&self) -> char { '{' }\n\n    fn b() -> &str {\n        r#\"} \"# \n    }\n}\n\nfn g() { let c = '\\''; }\n", [(1, 1), (2, 2), (4, 11), (5, 6), (8, 10), (13, 13)]),
    ("x.py", 'def a(\n    x,\n    y=")",\n):\n    """Doc {\nstring\n    """\n    return (\n1)\n# trailing\n\nclass B: pass\n\n# note\n@dec(\n    1)\nasync def c():\n    def d():\n        return 1\n\n    return d\nx = 1\n', [(1, 9), (12, 12), (14, 21), (18, 19)]),
    ("x.rb", "module M\n  # doc\n  def a(x)\n    x\n  end\n\n  class B\n    def c; end\n  end\nend\n", [(1, 10), (2, 5), (7, 9), (8, 8)]),
    ("x.c", "#include <a.h>\n\nstatic int f(int a)\n{\n  while (a) { a--; }\n  return a;\n}\n\nstruct s {\n  int a;\n};\nint x[] = { 1, 2 };\n", [(3, 7), (9, 11)]),
    ("x.sh", 'foo() {\n  echo "}"\n}\nfunction bar {\n  :\n}\nif (x) { y }\n', [(1, 3), (4, 6)]),
    ("y.js", "let a = 1\n\nfunction f(x) {\n  return x\n}\nconst g = async (y) => {\n  z()\n}\nclass A extends B {\n  constructor() { super() }\n  get x() {\n    return 1\n  }\n}\nfoo(a, (q) => {\n  1\n})\n", [(3, 5), (6, 8), (9, 14), (10, 10), (11, 13), (15, 17)]),
    ("y.go", "package main\n\n// A adds.\n// It does.\nfunc (t *T) A() error {\n\tif err := f(); err != nil {\n\t\treturn err\n\t}\n\tgo func() { x() }()\n\treturn nil\n}\n\ntype X struct {\n\ta int\n}\n", [(3, 11)]),
    ("y.c", "#define A(x) \\\n  { x }\nint\nmain(void)\n{\n  return 0;\n}\n", [(3, 7)]),
    ("y.json", '{"class": {"a": 1}}', []), ("y.py", "", []), ("noext", "fn a() {}", []), ("y.rs", "}}}\nfn a() {\n", []), ("dir.rs/y", "fn a() {}", []),
    ("Y.PY", '"""doc\ndef no():\n  pass\n"""\ndef yes():\n  pass', [(5, 6)]),
]


@pytest.mark.parametrize("path, source, spans", CASES)
def test_spans_of_a_file(path, source, spans):
    assert definition_spans(path, source) == spans


def test_any_text_has_spans_in_order_and_bounds():
    rng = random.Random(2)
    parts = ["{", "}", "(", ")", ";", "\n", "fn a()", "class B", "def c():", "    ", '"', "'", "`", "//", "/*", "*/", "#", "@x", "end", "=>", "\\", "r#"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(60)))
        for name in ("a.rs", "a.py", "a.js", "a.go", "a.java", "a.cpp", "a.rb", "a.sh"):
            spans = definition_spans(name, text)
            assert spans == sorted(set(spans)) and all(1 <= a <= b <= text.count("\n") + 1 for a, b in spans)


def table(spark, rows):
    return spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(rows)], "path string, doc_id long, text string")


def test_as_a_table_function(spark):
    files = table(spark, [(p, s) for p, s, _ in CASES if p[0] in "ax"] + [("n.rs", None), (None, "fn a() {}")])
    want = sorted((p, *span) for p, _, spans in CASES if p[0] in "ax" for span in spans)
    assert sorted(map(tuple, definitions.definitions(files).collect())) == want
    definitions.register(spark)
    files.createOrReplaceTempView("code_files")
    rows = spark.sql("SELECT path, d.start_line, d.end_line FROM code_files, LATERAL definition_spans(path, text) d")
    assert sorted(map(tuple, rows.collect())) == want


def test_blocks_fall_back(spark):
    files = table(spark, [("a.py", CASES[3][1]), ("a.zzz", "outer:\n    inner_call()\n"), ("b.py", "x = 1\ny = 2\n"), ("c.py", "def long():\n" + "    pass\n" * 60)])
    lines = carriers.lines(files)
    blocks = sorted(map(tuple, definitions.all_blocks(files, lines).collect()))
    assert blocks == [("a.py", 1, 3), ("a.py", 2, 3), ("a.zzz", 1, 3), ("b.py", 1, 3), ("c.py", 1, 48), ("c.py", 49, 62)]
    hits = spark.createDataFrame([("a.py", 3), ("a.py", 1), ("a.zzz", 2), ("b.py", 1), ("c.py", 30)], "path string, line_no int")
    found = {(r.path, r.line_no): (r.start_line, r.end_line) for r in definitions.enclosing_definition(files, lines, hits).collect()}
    assert found == {("a.py", 3): (2, 3), ("a.py", 1): (1, 3), ("a.zzz", 2): (1, 2), ("b.py", 1): (None, None), ("c.py", 30): (None, None)}


def test_tightest_span_equals_trying_all(spark):
    rng = random.Random(7)
    spans = [(rng.choice("ab"), a := rng.randrange(1, 300), a + rng.randrange(-1, 70)) for _ in range(500)] + [("a", 5, 9)] * 2
    hits = [(p, n) for p in "abc" for n in range(1, 330, 3)]
    got = {(r.path, r.line_no): (r.start_line, r.end_line) for r in definitions.tightest_span(spark.createDataFrame(hits + hits[:3], "path string, line_no int"), spark.createDataFrame(spans, "path string, start_line int, end_line int")).collect()}
    for p, n in hits:
        around = [(b - a, a, b) for q, a, b in spans if q == p and a <= n <= b and b - a < 48]
        assert got[p, n] == (min(around)[1:] if around else (None, None))
    plan = definitions.tightest_span(spark.createDataFrame(hits, "path string, line_no int"), spark.createDataFrame(spans, "path string, start_line int, end_line int"))
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_answers_by_definition(spark):
    from tessera.plans.retrieve import Options, retrieve

    text = "class Widget:\n" + "".join(f"    def step{i}(self):\n        {'needle' if i == 3 else 'x'}()\n\n    # gap\n" for i in range(6))
    files = spark.createDataFrame([("a.py", 1, text, len(text), text.count("\n") + 1)], "path string, doc_id long, text string, bytes long, line_count int")
    (found,) = retrieve(files, "needle", Options(by_definition=True)).collect()
    assert (found.start_line, found.end_line) == (13, 15)


def test_enclosing_definition_looks_into_a_file_once(spark):
    """Spans by the table function and by stretches, then blocks of the rest, give the same; no line is dealt out but as a hit."""
    files = code_files(spark, "/root/testdata/sf0.001").where("doc_id % 5 = 0")
    files = files.union(spark.createDataFrame([("x/none.rs", -1, None)], files.schema)).union(spark.createDataFrame([("x/odd.py", -2, "def a(): pass\r\n\n  x = 1\n    y\nclass B:\n  def c(self):\n    z")], files.schema))
    lines = carriers.lines(files)
    hits = lines.select("path", "line_no").union(spark.createDataFrame([("x/odd.py", 99), ("x/gone.py", 1), ("x/none.rs", 1)], "path string, line_no int"))
    exact = definitions.tightest_span(hits, definitions.definitions(files))
    rest = hits.join(exact.where("start_line is null"), ["path", "line_no"], "left_semi")
    want = exact.where("start_line is not null").unionByName(structure.enclosing_block(lines, rest))
    found = definitions.enclosing_definition(files, lines, hits)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "UDTF" not in plan and "stretch" not in plan
