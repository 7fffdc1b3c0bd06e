"""Evaluation of a labelled corpus of questions: reading and checking it, running its strategies, and holding reports against gates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.plans.batch import retrieve_batch
from tessera.plans.retrieve import Options, retrieved
from tessera.sources.repository import git

STRATEGIES = ("lexical", "prf")


@dataclass(frozen=True)
class Corpus:
    """Cases (id, question, expected targets) with the settings, strategies and gates of their evaluation."""

    name: str
    options: Options
    ks: tuple[int, ...]
    strategies: tuple[str, ...]
    cases: tuple[dict, ...]
    gates: dict[str, dict] = field(default_factory=dict)
    commit: str | None = None


class Report(NamedTuple):
    """Of a strategy: ``cases`` (``id, first_relevant_rank, delivered_tokens, chunks``), the totals by name, and the gates that it misses."""

    strategy: str
    cases: DataFrame
    totals: dict[str, float]
    failures: list[str]


def read_corpus(text: str) -> Corpus:
    """The corpus in a JSON text; what does not hold is an error. ``recallAt`` in a gate is another name of ``hitAt``."""
    raw = json.loads(text)

    def need(holds: object, message: str) -> None:
        if not holds:
            raise ValueError(message)

    need(raw.get("version") == 1, f"unsupported corpus version {raw.get('version')}")
    need(raw.get("cases"), "corpus contains no cases")
    need(raw.get("strategies"), "corpus contains no strategies")
    need(set(raw["strategies"]) <= set(STRATEGIES), "unknown strategy")
    need(raw.get("ks") and all(k > 0 for k in raw["ks"]), "ks must contain positive ranks")
    need(raw["budgetTokens"] > 0 and raw["maxHits"] > 0, "budgetTokens and maxHits must be positive")
    pin = raw.get("repository")
    if pin is not None:
        need(pin.get("url", "").strip(), "repository url must not be empty")
        need(re.fullmatch(r"[0-9a-fA-F]{40}", pin.get("commit", "")), "repository commit must be a full 40-character Git SHA")
    for case in raw["cases"]:
        need(case.get("id", "").strip() and case.get("question", "").strip(), "case id and question must not be empty")
        need(case.get("expected"), f"case {case['id']} contains no expected evidence")
        for target in case["expected"]:
            need(target.get("path", "").strip(), f"case {case['id']} contains an empty expected path")
            first, last = target.get("startLine"), target.get("endLine")
            need(first is None and last is None or first is not None and last is not None and 0 < first <= last, f"case {case['id']} expected ranges need both startLine/endLine and a valid order")
    gates = {}
    for strategy, gate in raw.get("gates", {}).items():
        at = {f"hit@{k}": float(v) for k, v in (gate.get("hitAt") or gate.get("recallAt") or {}).items()}
        more = {name: float(gate[key]) for name, key in (("mrr", "minMrr"), ("avg_tokens", "maxAvgTokens")) if gate.get(key) is not None}
        gates[strategy] = at | more
    options = Options(budget_tokens=raw["budgetTokens"], context_lines=raw["contextLines"], max_hits=raw["maxHits"], globs=tuple(raw.get("globs", ())))
    return Corpus(raw["name"], options, tuple(raw["ks"]), tuple(raw["strategies"]), tuple(raw["cases"]), gates, None if pin is None else pin["commit"])


def verify_pin(folder: str, commit: str) -> None:
    """An error unless the work tree is at ``commit`` and clean."""
    head = git(folder, "rev-parse", "HEAD").decode().strip()
    if head.lower() != commit.lower():
        raise ValueError(f"repository commit mismatch: expected {commit}, got {head}")
    if git(folder, "status", "--porcelain", "--untracked-files=all").strip():
        raise ValueError("repository checkout is dirty; external benchmarks require an exact clean commit")


def delivered(files: DataFrame, corpus: Corpus, strategy: str) -> DataFrame:
    """``query_id, path, start_line, end_line, estimated_tokens, rank`` for the cases by number: one batch, or a retrieval a case where feedback depends on the case."""
    columns = ("query_id", "path", "start_line", "end_line", "estimated_tokens", F.col("position").alias("rank"))
    spark = files.sparkSession
    if strategy == "lexical":
        questions = spark.createDataFrame([(i, c["question"]) for i, c in enumerate(corpus.cases)], "query_id long, question string")
        return retrieve_batch(files, questions, corpus.options).select(*columns)
    options = Options(**{**corpus.options.__dict__, "prf": True})
    parts = [retrieved(files, c["question"], options).chunks.withColumn("query_id", F.lit(i).cast("long")).select(*columns) for i, c in enumerate(corpus.cases)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate_corpus(files: DataFrame, corpus: Corpus) -> list[Report]:
    """A report for each strategy; a case is met by any one of its targets."""
    spark = files.sparkSession
    targets = [(i, t["path"], t.get("startLine"), t.get("endLine")) for i, c in enumerate(corpus.cases) for t in c["expected"]]
    expected = spark.createDataFrame(targets, "query_id long, path string, start_line int, end_line int")
    names = spark.createDataFrame([(i, c["id"]) for i, c in enumerate(corpus.cases)], "query_id long, id string")
    out = []
    for strategy in corpus.strategies:
        rows = delivered(files, corpus, strategy).persist()
        ranks = evaluation.first_ranks(rows, expected)
        told = rows.groupBy("query_id").agg(F.sum("estimated_tokens").alias("delivered_tokens"), F.count(F.lit(1)).alias("chunks"))
        cases = names.join(ranks.withColumnRenamed("rank", "first_relevant_rank"), "query_id", "left").join(told, "query_id", "left").fillna(0, ["delivered_tokens", "chunks"])
        totals = {f"hit@{r['k']}": r["hit_rate"] for r in evaluation.hit_at_k(ranks, corpus.ks).collect()}
        totals |= {"mrr": evaluation.mrr(ranks).first()["mrr"], "avg_tokens": cases.agg(F.avg("delivered_tokens")).first()[0]}
        out.append(Report(strategy, cases.select("id", "first_relevant_rank", "delivered_tokens", "chunks"), totals, evaluation.gate_failures(totals, corpus.gates.get(strategy, {}), 1e-6)))
    return out
