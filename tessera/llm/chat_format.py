r"""Conversations as training text, by a grammar round trip; DataFrame functions only.

A turn is written as its role's opening mark, a space, the text, a space and the closing mark::

    [SYS] text [/SYS]    [INST] text [/INST]    [ANS] text </s>    [ROLE]name[/ROLE] text [/TURN]

The last form is for every other role, so that none is lost. A rendered conversation is parsed again by a
deterministic grammar: a turn ends at the first control string behind its opening mark, whichever it is, and the
closing mark must be its role's own. What the parser recovers is compared with the source. Turns that do not come
back have their control strings escaped (a backslash behind the first character; one more where backslashes stand
there already), and where a conversation still differs, all its turns are escaped. Escaping is a bijection, so the
last round always comes back; that is checked too, and a failure is an error rather than a wrong text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing mark of the named roles, and of all others.
ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
NAME, NAMED, TURN = "[ROLE]", "[/ROLE]", "[/TURN]"
#: A control string with any number of backslashes behind its first character.
BRACKETED, ANGLED = r"(\[)(\\*)(/?(?:SYS|INST|ROLE)\]|ANS\]|/TURN\])", r"(<)(\\*)(/s>)"
#: Control strings as they stand in rendered text, and a whole turn: opening mark to the next control string.
CONTROL = r"\[/?(?:SYS|INST|ROLE)\]|\[ANS\]|\[/TURN\]|</s>"
WHOLE = rf"(?s)(?:\[SYS\]|\[INST\]|\[ANS\]|\[ROLE\].*?\[/ROLE\]) .*?(?:{CONTROL})"
TRAINED, LOT = "assistant", 1000


def escaped(text: Column) -> Column:
    """``text`` without a control string: each gets one more backslash behind its first character."""
    for pattern in (BRACKETED, ANGLED):
        text = F.regexp_replace(text, pattern, r"$1\\$2$3")
    return text


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    for pattern in (BRACKETED, ANGLED):
        text = F.regexp_replace(text, pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")
    return text


def opening(role: Column) -> Column:
    mark = F.concat(F.lit(NAME), escaped(role), F.lit(NAMED + " "))
    for name, (begin, _) in ROLES.items():
        mark = F.when(role == name, F.lit(begin + " ")).otherwise(mark)
    return mark


def closing(role: Column) -> Column:
    mark = F.lit(" " + TURN)
    for name, (_, end) in ROLES.items():
        mark = F.when(role == name, F.lit(" " + end)).otherwise(mark)
    return mark


def rendered(turn: Column, body: Column) -> Column:
    return F.concat(opening(turn["role"]), body, closing(turn["role"]))


def recovered(whole: Column) -> Column:
    """Role and text of one parsed turn; the role is null where the closing mark is not the role's own."""
    other = whole.startswith(NAME)
    role = F.when(other, unescaped(F.regexp_extract(whole, r"(?s)^\[ROLE\](.*?)\[/ROLE\] ", 1)))
    begin = F.when(other, F.position(F.lit(NAMED), whole) + len(NAMED) + 1)
    end = F.when(other, F.lit(" " + TURN))
    for name, (first, last) in ROLES.items():
        here = whole.startswith(first + " ")
        role, begin, end = F.when(here, F.lit(name)).otherwise(role), F.when(here, F.lit(len(first) + 2)).otherwise(begin), F.when(here, F.lit(" " + last)).otherwise(end)
    body = F.substring(whole, begin, F.char_length(whole) - begin + 1 - F.char_length(end))
    return F.struct(F.when(whole.endswith(end), role).alias("role"), unescaped(body).alias("text"))


def wholes(formatted: Column) -> Column:
    """The turns of a rendered text as written."""
    return F.regexp_extract_all(formatted, F.lit(WHOLE), F.lit(0))


def parsed(formatted: Column) -> Column:
    """Roles and texts of a rendered text; null where something in it is no turn."""
    found = wholes(formatted)
    return F.when(F.array_join(found, "") == formatted, F.transform(found, recovered))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, rounds`` of every conversation.

    ``loss_spans`` are the places under the loss mask, the texts of the assistant's turns as written, as ``start``
    and ``length`` in UTF-8 bytes, so that they can be cut out in one pass; ``rounds`` is 0 where nothing had to be
    escaped, 1 where conflicting turns were, 2 where all were. Turns are in order of ``turn``, role and text, nulls
    first; a null text or role is empty, repeated rows are turns of their own, rows with a null ``conv_id`` are one
    conversation, an empty table gives no rows, and other columns are ignored. A conversation is one row of the
    result, so it has to fit into one value (2 GB); that bound is the contract's, whose digests are over whole ones.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def attempt(body) -> Column:
        return F.array_join(F.transform("source", lambda t: rendered(t, body(t))), "")

    def conflict(t: Column) -> Column:
        return ~F.coalesce(parsed(rendered(t, t["text"])) == F.array(t), F.lit(False))

    def same(formatted: str) -> Column:
        return F.coalesce(parsed(F.col(formatted)) == F.col("source"), F.lit(False))

    def after(tried: str, formatted: Column) -> Column:
        return F.when(F.col(tried + "_same"), F.col(tried)).otherwise(formatted)

    # Each round is a projection of its own: the next one reads its text and the verdict on it, and does nothing where it was the same.
    raw = source.withColumn("raw", attempt(lambda t: t["text"])).withColumn("raw_same", same("raw"))
    some = raw.withColumn("some", after("raw", attempt(lambda t: F.when(conflict(t), escaped(t["text"])).otherwise(t["text"]))))
    some = some.withColumn("some_same", F.col("raw_same") | same("some"))
    every = some.withColumn("every", after("some", attempt(lambda t: escaped(t["text"])))).withColumn("every_same", F.col("some_same") | same("every"))
    right = F.when(F.col("every_same"), F.col("every")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its turns")))
    rounds = F.when(F.col("raw_same"), 0).when(F.col("some_same"), 1).otherwise(2)
    return every.select("conv_id", right.alias("formatted"), rounds.alias("rounds")).withColumn("loss_spans", loss_spans(F.col("formatted")))


def loss_spans(formatted: Column) -> Column:
    """Where the bodies of the trained role stand, in bytes; by lots of ``LOT`` turns, as every step copies its lot's spans."""
    begin, end = ROLES[TRAINED]
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def step(state: Column, whole: Column) -> Column:
        size = F.octet_length(whole).cast("long")
        span = F.struct((state["at"] + len(begin) + 1).alias("start"), (size - len(begin) - len(end) - 2).alias("length"))
        return F.struct((state["at"] + size).alias("at"), F.when(whole.startswith(begin), F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def behind(state: Column, lot: Column) -> Column:
        moved = F.transform(lot["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["length"].alias("length")))
        return F.struct((state["at"] + lot["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    def of(turns: Column) -> Column:
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / LOT).cast("int")), lambda i: F.aggregate(F.slice(turns, i * LOT + 1, LOT), zero, step))
        return F.aggregate(lots, zero, behind, lambda s: s["spans"])

    return F.flatten(F.transform(F.array(wholes(formatted)), of))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    one = F.array(formatted.cast("binary"))  # bound once, so that a span costs its own bytes
    return F.flatten(F.transform(one, lambda data: F.transform(spans, lambda s: unescaped(F.substring(data, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string")))))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns and masked texts as counts and digests."""
    turns = formatted.select("conv_id", "formatted", "rounds", parsed(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("rounds").cast("int").alias("rounds"),
    )


def with_trap(conversations: DataFrame) -> DataFrame:
    """``conversations`` with conversation -7, whose two turns are control strings."""
    kinds = dict(conversations.dtypes)
    trap = conversations.sparkSession.sql(r"SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    names = ("conv_id", "turn", "role", "text")
    return conversations.select(*names).unionByName(trap.select(*(F.col(n).cast(kinds[n]) for n in names)))


#: The same rows by DuckDB: a turn is escaped where it holds a control string, with backslashes or not.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), written AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\[)(\\*)(/?(?:SYS|INST|ROLE)\]|ANS\]|/TURN\])', '\1\\\2\3', 'g'), '(<)(\\*)(/s>)', '\1\\\2\3', 'g') AS body,
    regexp_replace(regexp_replace(role, '(\[)(\\*)(/?(?:SYS|INST|ROLE)\]|ANS\]|/TURN\])', '\1\\\2\3', 'g'), '(<)(\\*)(/s>)', '\1\\\2\3', 'g') AS name
  FROM rows
), sized AS (
  SELECT *, length(body) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE length(name) + 22 END AS size FROM written
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  (CASE WHEN bool_or(body <> text) THEN 1 ELSE 0 END)::INTEGER AS rounds
FROM sized GROUP BY conv_id
"""
