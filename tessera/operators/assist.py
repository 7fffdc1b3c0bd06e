"""Checks of what a model writes: findings must be grounded in the excerpts that it was given."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import utf16_length, verify_hint
from tessera.operators.structure import merge_with_gap

SUMMARY_UNITS = 2000


def findings_validation(findings: DataFrame, excerpts: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """``findings`` with ``reason`` (null: kept) and ``verify_hint``.

    ``excerpts`` are the ranges (``path, start_line, end_line``) that were shown; near ones count as one range. Where
    each reply was shown others, ``by`` names its column besides ``path``.
    """
    allowed = merge_with_gap(excerpts, by=by).groupBy(*by).agg(F.collect_list(F.struct("start_line", "end_line")).alias("allowed"))
    rows = findings.join(allowed, list(by), "left")
    inside = F.exists("allowed", lambda a: (a["start_line"] <= F.col("start_line")) & (F.col("end_line") <= a["end_line"]))
    reason = (
        F.when(utf16_length(F.col("summary")) > SUMMARY_UNITS, "summary_too_long")
        .when(F.col("allowed").isNull(), "unknown_path")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "invalid_range")
        .when(~inside, "outside_evidence")
    )
    hint = F.when(reason.isNull(), verify_hint(F.col("path"), F.col("start_line"), F.col("end_line")))
    return rows.select(*findings.columns, reason.alias("reason"), hint.alias("verify_hint"))


def expansion_terms(reply: str, limit: int = 8) -> list[str]:
    """Terms from a model's JSON reply, wrapped or bare; nothing from a malformed one."""
    try:
        value = json.loads(reply)
    except ValueError:
        return []
    value = value.get("terms", []) if isinstance(value, dict) else value
    out: dict[str, str] = {}
    for term in value if isinstance(value, list) else []:
        if isinstance(term, str) and 2 <= len(term.encode()) <= 64 and not any(c.isspace() for c in term):
            out.setdefault(term.lower(), term)
    return list(out.values())[:limit]


def reply_scores(reply: str, expected: int) -> list[float]:
    """Scores from a model's JSON reply, each within 0 and 1; as many as were asked for, or an error."""
    value = json.loads(reply)
    value = value.get("scores") if isinstance(value, dict) else value
    if not isinstance(value, list) or len(value) != expected or not all(isinstance(x, int | float) for x in value):
        raise ValueError("the reply's scores do not fit")
    return [min(1.0, max(0.0, float(x))) for x in value]


def first_that_works(models: Sequence[str], ask: Callable[[str], str], check: Callable[[str], dict]) -> tuple[dict, bool]:
    """The first model's reply that passes ``check``, and whether it took a fallback."""
    failures = []
    for i, model in enumerate(dict.fromkeys(models)):
        try:
            return check(ask(model)), i > 0
        except Exception as e:  # any failure goes on to the next model
            failures.append(f"{model}: {e}")
    raise RuntimeError("fallback exhausted: " + "; ".join(failures))
