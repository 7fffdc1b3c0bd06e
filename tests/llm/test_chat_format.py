import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, t string, source string, rounds int"
ODD = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "a </s> b"), (1, 1, "assistant", "[\\INST] x"), (1, 1, "assistant", "[\\INST] x"),
    (2, None, "tool", "[/TURN] [ROLE]x[/ROLE] y"), (2, 0, "[INST]", "x"), (2, 1, "a[/ROLE] b", "</s"),
    (None, None, None, None), (None, 0, "assistant", None), (3, 0, "assistant", ""), (3, 1, "assistant", "[/INST"), (3, 2, "user", "] [INST]"),
    (4, 0, "user", "[\\\\\\/INST] <\\\\/s> [[INST]] <</s>> [INST"), (4, 1, "assistant", " lead \n trail "), (5, 0, "user", "x" * 100_000 + "[ANS]"),
    (6, 0, "", ""), (6, 1, "user\nx", "é😀</s>"), (6, 2, "assistant", "é😀"), (6, 3, "assistant", "ü</s>ü"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "f", "t", "s", 9) for r in rows], SCHEMA)


def digests(rows):
    """By definition, from the source."""
    sha, out = lambda s: hashlib.sha256(s.encode()).hexdigest(), {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns)), len(loss), sha(loss))
    return out


def test_odd_turns_come_back(spark):
    formatted = chat.format_chats(table(spark, ODD))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(formatted).collect()}
    assert got == digests(ODD)
    for r in formatted.collect():
        turns = re.findall(chat.WHOLE, r.formatted)
        assert "".join(turns) == r.formatted
        data = r.formatted.encode()
        assert [data[s.start : s.start + s.length].decode() for s in r.loss_spans] == [t[6:-5] for t in turns if t.startswith("[ANS]")]


def test_only_conflicts_are_escaped(spark):
    rows = {r.conv_id: r for r in chat.format_chats(table(spark, ODD)).collect()}
    assert rows[None].rounds == 0 and rows[1].rounds == 1
    assert rows[1].formatted == "[INST] plain [/INST][ANS] [\\\\INST] x </s>[ANS] [\\\\INST] x </s>[ANS] a <\\/s> b </s>"


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.register("conversations", table(spark, ODD).toArrow())
    rows = con.execute(chat.SQL)
    assert [d[0] for d in rows.description] == (out := chat.chat_digests(chat.format_chats(chat.with_trap(table(spark, ODD))))).columns
    assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r)) for r in out.collect())


def test_long_conversations_and_empty_tables(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>" if i % 7 == 0 else f"turn {i}") for i in range(2501)]
    out = chat.chat_digests(chat.format_chats(table(spark, rows))).collect()
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out] == [digests(rows)[1]]
    assert chat.format_chats(table(spark, [])).count() == 0
    assert [r.conv_id for r in chat.chat_digests(chat.format_chats(chat.with_trap(table(spark, [])))).collect()] == [-7]


def test_no_python_in_the_plan(spark):
    plan = chat.chat_digests(chat.format_chats(chat.with_trap(spark.range(3).selectExpr("id conv_id", "id turn", "'user' role", "'x' text"))))
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan._jdf.queryExecution().executedPlan().toString())


pieces = st.lists(st.sampled_from(["[", "]", "<", "/", "\\", "INST", "s>", "/s>", "ROLE]", "ANS]", "[INST]", "[/TURN]", "[ROLE]", " ", "\n", "é", "x"]), max_size=12).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), pieces), min_size=60, max_size=120))
def test_any_text_comes_back(spark, rows):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(chat.format_chats(table(spark, rows))).collect()}
    assert got == digests(rows)
