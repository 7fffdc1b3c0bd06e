"""What models reply, read leniently: JSON of any shape as a VARIANT, checked against what each was shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import utf16_length
from tessera.operators.assist import findings_validation

# Fixed bounds of a reply: UTF-16 units of the answer and of an uncertainty, findings, uncertainties.
ANSWER_UNITS, UNCERTAINTY_UNITS, FINDINGS, UNCERTAINTIES = 16_000, 2_000, 100, 50


def kind_of(value: Column) -> Column:
    """``VOID`` for null, ``STRING``, ``BIGINT``, ``ARRAY``, ``OBJECT`` and so on; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def listed(value: Column) -> Column:
    """The items of a value: of an array its own, nothing for null or no value, else the value itself."""
    empty = F.expr("cast(array() as array<variant>)")
    kind = kind_of(value)
    return F.when(value.isNull() | (kind == "VOID"), empty).when(kind == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def texts(value: Column) -> Column:
    """The items of a value as text: strings as they are, anything else as JSON."""
    return F.transform(listed(value), lambda x: F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))


def whole(value: Column) -> Column:
    """A whole number of 0 or more; null for anything else."""
    number = F.try_variant_get(value, "$", "long")
    return F.when(kind_of(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT") & (number >= 0), number)


def text(value: Column) -> Column:
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def finding(value: Column) -> Column:
    """A finding's fields; null where one that has to be there is missing or of another kind."""
    severity = field(value, "severity")
    made = F.struct(
        text(field(value, "path")).alias("path"),
        whole(field(value, "startLine")).alias("start_line"),
        whole(field(value, "endLine")).alias("end_line"),
        text(field(value, "summary")).alias("summary"),
        text(severity).alias("severity"),
    )
    fits = (kind_of(value) == "OBJECT") & (severity.isNull() | kind_of(severity).isin("STRING", "VOID"))
    for name in ("path", "start_line", "end_line", "summary"):
        fits = fits & made[name].isNotNull()
    return F.when(fits, made)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """``reply_id, error, answer, findings, uncertainties`` of every reply (``reply_id, content``).

    Keys may be missing, null, a single value instead of a list, or unknown. What is no JSON object, has an answer that
    is no text or a finding that lacks a field is ``model returned invalid JSON``; too many items or too long a text
    reject the whole reply. Of a reply with an ``error`` the rest is null.
    """
    v = replies.select("reply_id", F.try_parse_json("content").alias("v"))
    answer, found = field(F.col("v"), "answer"), F.transform(listed(field(F.col("v"), "findings")), finding)
    rows = v.select(
        "reply_id",
        (F.col("v").isNotNull() & (kind_of(F.col("v")) == "OBJECT") & (answer.isNull() | (kind_of(answer) == "STRING"))).alias("fits"),
        F.coalesce(text(answer), F.lit("")).alias("answer"),
        found.alias("findings"),
        texts(field(F.col("v"), "uncertainties")).alias("uncertainties"),
    )
    long = F.array_position(F.transform("uncertainties", lambda u: utf16_length(u) > UNCERTAINTY_UNITS), True)
    error = (
        F.when(~F.coalesce("fits", F.lit(False)) | F.exists("findings", lambda f: f.isNull()), "model returned invalid JSON")
        .when(utf16_length(F.col("answer")) > ANSWER_UNITS, f"model response field answer exceeds {ANSWER_UNITS} characters")
        .when((F.size("findings") > FINDINGS) | (F.size("uncertainties") > UNCERTAINTIES), "model response contains too many items")
        .when(long > 0, F.concat(F.lit("model response field uncertainties["), (long - 1).cast("string"), F.lit(f"] exceeds {UNCERTAINTY_UNITS} characters")))
    )
    rows = rows.withColumn("error", error)
    return rows.select("reply_id", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("answer", "findings", "uncertainties")])


def grounded_replies(replies: DataFrame, excerpts: DataFrame) -> DataFrame:
    """``reply_id, error, answer, findings, dropped_findings, uncertainties``: findings that lie in what the reply was shown, and the others with a reason.

    ``excerpts`` has ``reply_id, path, start_line, end_line``. A reply whose findings are all dropped is an error. The
    findings of a reply, a hundred at most, come together again; ``reply_id`` is unique.
    """
    read = parsed_replies(replies)
    each = read.select("reply_id", F.posexplode("findings").alias("at", "f")).select("reply_id", "at", "f.*")
    checked = findings_validation(each, excerpts, ("reply_id", "path"))
    item = F.struct("at", "path", "start_line", "end_line", "summary", "severity", "reason", "verify_hint")
    sorted_ = checked.groupBy("reply_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fields = ("path", "start_line", "end_line", "summary", "severity")

    def part(wanted, *more: str) -> Column:
        return F.transform(F.filter("items", wanted), lambda x: F.struct(*[x[c].alias(c) for c in (*fields, *more)]))

    rows = read.drop("findings").join(sorted_, "reply_id", "left").withColumn("items", F.coalesce("items", F.filter(F.array(F.lit(None).cast(sorted_.schema["items"].dataType.elementType)), lambda x: F.lit(False))))
    rows = rows.withColumn("findings", part(lambda x: x["reason"].isNull(), "verify_hint")).withColumn("dropped_findings", part(lambda x: x["reason"].isNotNull(), "reason"))
    fell = (F.size("findings") == 0) & (F.size("dropped_findings") > 0)
    reasons = F.array_join(F.transform("dropped_findings", lambda x: x["reason"]), ", ")
    rows = rows.withColumn("error", F.coalesce("error", F.when(fell, F.concat(F.lit("all findings were dropped: "), reasons))))
    return rows.select("reply_id", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("answer", "findings", "dropped_findings", "uncertainties")])


def score_replies(replies: DataFrame) -> DataFrame:
    """``reply_id, scores``: as many scores as were ``expected`` (``reply_id, content, expected``), each within 0 and 1; null where the reply does not fit."""
    v = replies.select("reply_id", "expected", F.try_parse_json("content").alias("v"))
    bare = F.when(kind_of(F.col("v")) == "OBJECT", field(F.col("v"), "scores")).otherwise(F.col("v"))
    rows = v.select("reply_id", "expected", F.when(kind_of(bare) == "ARRAY", F.try_variant_get(bare, "$", "array<variant>")).alias("items"))
    number = lambda x: F.when(kind_of(x).rlike("INT$|^DECIMAL|^DOUBLE|^FLOAT"), F.try_variant_get(x, "$", "double"))
    rows = rows.withColumn("scores", F.transform("items", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(x)))))
    right = (F.size("items") == F.col("expected")) & ~F.exists("items", lambda x: number(x).isNull())
    return rows.select("reply_id", F.when(right, F.col("scores")).alias("scores"))


def expansion_replies(replies: DataFrame, limit: int = 8) -> DataFrame:
    """``reply_id, terms``: the terms of a reply (``reply_id, content``), bare or under ``terms``; none where it does not fit.

    Texts of 2 to 64 bytes without white space, each once without regard to case, in order.
    """
    v = replies.select("reply_id", F.try_parse_json("content").alias("v"))
    bare = F.when(kind_of(F.col("v")) == "OBJECT", field(F.col("v"), "terms")).otherwise(F.col("v"))
    items = F.when(kind_of(bare) == "ARRAY", F.try_variant_get(bare, "$", "array<variant>"))
    terms = F.filter(F.transform(items, text), lambda t: t.isNotNull() & F.octet_length(t).between(2, 64) & ~t.rlike(r"[\p{IsWhite_Space}]"))
    rows = v.select("reply_id", F.coalesce(terms, F.array().cast("array<string>")).alias("t")).withColumn("low", F.transform("t", F.lower))
    first = F.filter("t", lambda t, i: F.array_position("low", F.lower(t)) == i + 1)
    return rows.select("reply_id", F.slice(first, 1, limit).alias("terms"))
