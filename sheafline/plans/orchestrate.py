"""From documents and questions to checked answers, with parts that can be exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from . import baseline


class Documents(Protocol):
    """Where extracted documents come from."""

    def all(self) -> DataFrame: ...
    def one(self, doc_id: str) -> DataFrame: ...
    def coverage(self) -> DataFrame: ...


class Store(Protocol):
    """Tables of works, letters and personnel."""

    def tables(self) -> dict[str, DataFrame]: ...


class Solver(Protocol):
    """Answers questions: qid, answer."""

    def solve(self, questions: DataFrame) -> DataFrame: ...


class ExtractedDocuments:
    def __init__(self, envelopes: DataFrame, index: DataFrame):
        self.envelopes, self.index = envelopes, index

    def all(self) -> DataFrame:
        return self.envelopes

    def one(self, doc_id: str) -> DataFrame:
        return self.envelopes.where(F.col("doc_id") == doc_id)

    def coverage(self) -> DataFrame:
        """total, extracted, missing, pct of the index."""
        got = self.index.select("doc_id").distinct().join(self.envelopes.select("doc_id").distinct().withColumn("_has", F.lit(1)), "doc_id", "left")
        return got.agg(F.count("*").alias("total"), F.count("_has").alias("extracted")).select("total", "extracted", (F.col("total") - F.col("extracted")).alias("missing"), (100.0 * F.col("extracted") / F.nullif("total", F.lit(0))).alias("pct"))


class TableStore:
    def __init__(self, **tables: DataFrame):
        self._tables = tables

    def tables(self) -> dict[str, DataFrame]:
        return self._tables


class BaselineSolver:
    def __init__(self, store: Store):
        self.store = store

    def solve(self, questions: DataFrame) -> DataFrame:
        t = self.store.tables()
        return baseline.solve(questions, t["certificates"], t["letters"], t["personnel"]).select("qid", "answer")


def outside_choices(shortlists: DataFrame, choose: Callable[[str, list[str]], str | None]) -> DataFrame:
    """Layer 4 of the resolution: qid, entity that a function (such as a language model's client) picks from each shortlist.

    shortlists: qid, text, shortlist. What is not on the list counts as no choice. Off unless called.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chosen = [choose(text, list(names)) for text, names in zip(batch["text"], batch["shortlist"], strict=True)]
            rows = [(q, c) for q, c, names in zip(batch["qid"], chosen, batch["shortlist"], strict=True) if c in list(names)]
            yield pd.DataFrame(rows, columns=["qid", "entity"])

    return shortlists.select("qid", "text", "shortlist").mapInPandas(pick, "qid string, entity string")


def run(questions: DataFrame, solver: Solver, kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """Answers, repaired answers, issues, summary, anomalies and, where there are gold values, scores.

    kept: answers (qid, answer) of an earlier run; only questions without one are solved.
    """
    todo = questions if kept is None else questions.join(kept.select("qid"), "qid", "left_anti")
    answers = solver.solve(todo)
    if kept is not None:
        answers = answers.unionByName(kept.select("qid", "answer").join(questions.select("qid"), "qid", "left_semi"))
    raw = answers.select("qid", F.col("answer").cast("string").alias("raw_answer"), F.lit(0).cast("long").alias("row_num"))
    out = {
        "answers": answers,
        "repaired": quality.repair(questions, raw),
        "issues": quality.validate(questions, raw),
        "summary": quality.validation_summary(questions, raw),
        "anomalies": quality.anomalies(questions, raw),
        "by_type": quality.type_statistics(questions, raw),
    }
    if "gold" in questions.columns:
        scored = quality.scored(questions, raw)
        dimensions = tuple(d for d in ("shape", "answer_type", "hops") if d in questions.columns)
        worst, best = quality.extremes(scored)
        out |= {"scores": quality.breakdown(scored, dimensions), "histogram": quality.histogram(scored), "worst": worst, "best": best}
    return out
