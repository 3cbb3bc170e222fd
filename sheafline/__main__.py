"""python -m sheafline COMMAND, on files of questions and answers.

validate, score, compare, export, coverage and history look at answers; answers makes them from tables, e2e makes, checks,
repairs and reports them, freeze keeps a release, and self-test scores a table of known cases.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .operators import quality
from .operators.lineage import cut
from .plans import ask


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sheafline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "validate": ("questions", "answers"),
        "score": ("questions", "answers"),
        "compare": ("baseline", "candidate"),
        "export": ("questions", "answers", "out"),
        "coverage": ("index", "extracted"),
        "history": ("questions", "answers", "out"),
        "answers": ("questions", "tables", "out"),
        "e2e": ("questions", "tables", "out"),
        "freeze": ("questions", "answers"),
        "self-test": (),
    }.items():
        command = commands.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
        if name == "compare":
            command.add_argument("--gold")
        if name == "e2e":
            command.add_argument("--cache", help="a folder of answers that are kept from run to run")
            command.add_argument("--report", help="a file for the report")
    return top


def answers(spark: SparkSession, path: str) -> DataFrame:
    return sources.answer_lines(spark, path) if path.endswith(".jsonl") else sources.submission(spark, path)


# Gold value, what was answered, and the score of it.
CASES = (
    (1_000_000_000.0, "1000000000", 1.0), (1_000_000_000.0, "1050000000", 0.95), (1_000_000_000.0, "950000000", 0.95), (1_000_000_000.0, "1500000000", 0.5), (1_000_000_000.0, "2000000000", 0.0), (1_000_000_000.0, "5000000000", 0.0),
    (100.0, "99", 0.99), (5.0, "5", 1.0), (5.0, "4", 0.8), (66.67, "66.67", 1.0), (66.67, "0.6667", 0.01), (1_000_000_000.0, None, 0.0), (1_000_000_000.0, "not a number", 0.0), (0.0, "0", 1.0), (0.0, "5", 0.0),
)


def self_test(spark: SparkSession) -> DataFrame:
    """The cases whose score is not as it should be."""
    rows = spark.createDataFrame(list(CASES), "gold double, raw_answer string, wanted double")
    scored = rows.withColumn("score", quality.score_one(F.col("gold"), quality.submitted_number(F.col("raw_answer"))))
    return scored.where(F.abs(F.col("score") - F.col("wanted")) > 5e-3)


class TablesSolver:
    """Answers questions by the primary solver from certificates, letters, receivables and personnel in one folder (Parquet)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = [spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in ("certificates", "letters", "receivables", "personnel")]

    def solve(self, questions: DataFrame) -> DataFrame:
        return ask.answer(questions.select("qid", "question", "answer_type"), *self.tables).select("qid", "answer")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    last = quality.last_write_wins(answers(spark, path))
    return last.select("qid", quality.submitted_number(F.col("raw_answer")).alias("answer"))


def end_to_end(spark: SparkSession, questions: DataFrame, options: argparse.Namespace) -> int:
    """Answers what is not kept yet, keeps it, repairs, writes and checks all answers, and scores them where gold values are known."""
    kept, todo = sinks.cached_answers(spark, questions, options.cache) if options.cache else (None, questions)
    fresh = cut(TablesSolver(spark, options.tables).solve(todo))
    if kept is not None:
        sinks.keep_answers(fresh, options.cache)
    every = fresh if kept is None else fresh.unionByName(kept.join(questions.select("qid"), "qid", "left_semi").join(fresh.select("qid"), "qid", "left_anti"))
    raw = every.select("qid", F.col("answer").cast("string").alias("raw_answer"), F.lit(0).cast("long").alias("row_num"))
    repaired = cut(quality.repair(questions, raw))
    sinks.answers_csv(repaired, options.out)
    written = repaired.select("qid", F.col("answer").cast("string").alias("raw_answer"), F.lit(0).cast("long").alias("row_num"))
    summary = quality.validation_summary(questions, written)
    sections = {"summary": summary, "by type": quality.type_statistics(questions, written).orderBy("answer_type"), "issues": quality.validate(questions, written).orderBy("severity", "qid", "code"), "anomalies": quality.anomalies(questions, written)}
    known = questions.where("gold is not null")
    if not known.isEmpty():
        scored = quality.scored(known, written)
        sections |= {"scores": quality.breakdown(scored).orderBy("dimension", F.desc("percentage")), "histogram": quality.histogram(scored).orderBy("place")}
    report = sinks.markdown("End to end", sections)
    print(report)
    if options.report:
        with open(options.report, "w", encoding="utf-8") as out:
            out.write(report)
    return 0 if summary.first()["is_valid"] else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sheafline").getOrCreate()
    show = lambda title, **sections: print(sinks.markdown(title, sections))
    if options.command == "compare":
        gold = sources.questions(spark, options.gold) if options.gold else None
        rows = quality.compare(numbered(spark, options.baseline), numbered(spark, options.candidate), gold)
        show("Comparison", statuses=rows.groupBy("status").count().orderBy("status"), changed=rows.where("status <> 'UNCHANGED'").orderBy("qid"))
        return 0
    if options.command == "coverage":
        index, got = sources.index(spark, options.index), sources.envelopes(spark, options.extracted)
        fields = got.select("doc_id", F.from_json("extracted_data", "map<string, string>").alias("fields"))
        show("Coverage", by_type=quality.coverage(index, fields).orderBy("doc_type"))
        return 0
    if options.command == "self-test":
        wrong = self_test(spark)
        show("Self-test", wrong=wrong)
        return 0 if wrong.isEmpty() else 1
    questions = sources.questions(spark, options.questions)
    if options.command == "answers":
        sinks.answers_csv(TablesSolver(spark, options.tables).solve(questions), options.out)
        return 0
    if options.command == "e2e":
        return end_to_end(spark, questions, options)
    given = answers(spark, options.answers)
    if options.command == "freeze":
        valid = bool(quality.validation_summary(questions, given).first()["is_valid"])
        if not valid:
            show("Not released", issues=quality.validate(questions, given).where("severity = 'ERROR'").orderBy("qid", "code"))
            return 1
        print(sinks.freeze(spark, options.answers, valid))
        return 0
    if options.command == "validate":
        summary = quality.validation_summary(questions, given)
        show("Validation", summary=summary, issues=quality.validate(questions, given).orderBy("severity", "qid", "code"), anomalies=quality.anomalies(questions, given))
        return 0 if summary.collect()[0]["is_valid"] else 1
    if options.command == "export":
        sinks.answers_csv(quality.repair(questions, given), options.out)
        return 0
    scored = quality.scored(questions, given)
    total = scored.agg(F.sum("score").alias("score"), F.count("*").alias("questions"), F.avg("score").alias("mean"))
    if options.command == "history":
        sinks.history(total, options.out)
        return 0
    worst, _ = quality.extremes(scored)
    show("Scores", total=total, breakdown=quality.breakdown(scored).orderBy("dimension", F.desc("percentage")), histogram=quality.histogram(scored).orderBy("place"), worst=worst.select("qid", "gold", "got", "score"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
