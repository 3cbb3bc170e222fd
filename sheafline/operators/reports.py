"""Reports on questions, answers, logs and extracted tables, each a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import implausible, valid_number
from .lineage import cut
from .quality import upper_median
from .works import last_write_wins


def _answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    last = last_write_wins(answers).select("qid", valid_number(F.col("raw_answer")).alias("v"), F.lit(True).alias("answered"))
    return questions.join(last, "qid", "left")


def plausibility(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: total, answered, missing, extra, flagged, clean. questions: qid, answer_type. answers: qid, raw_answer, row_num."""
    rows = _answered(questions, answers)
    has = F.coalesce("answered", F.lit(False))
    odd = F.size(implausible(F.col("v"), F.col("answer_type"))) > 0
    extra = answers.select("qid").distinct().join(questions.select("qid"), "qid", "left_anti").agg(F.count("*").alias("extra"))
    counts = rows.agg(F.count("*").alias("total"), F.count_if(has).alias("answered"), F.count_if(~has).alias("missing"), F.count_if(has & odd).alias("flagged"), F.count_if(has & ~odd).alias("clean"))
    return counts.join(F.broadcast(extra)).select("total", "answered", "missing", "extra", "flagged", "clean")  # one row each


def flagged(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, answer_type, value and code of every answer that looks wrong, a row for each code."""
    rows = _answered(questions, answers).where("answered")
    return rows.select("qid", "answer_type", F.col("v").alias("value"), F.explode(implausible(F.col("v"), F.col("answer_type"))).alias("code"))


def canaries(questions: DataFrame, answers: DataFrame, watched: DataFrame) -> DataFrame:
    """The watched questions (qid, why) with what was answered; answered is false where nothing was."""
    rows = _answered(questions, answers)
    return watched.join(rows, "qid").select("qid", "why", "question", F.col("v").alias("value"), F.coalesce("answered", F.lit(False)).alias("answered"))


def distribution_of_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """answer_type, n, low, median (the upper one), high, zeros of the numbers answered."""
    # three passes follow; the joins and the last answers are worked out for the first alone
    rows = cut(_answered(questions, answers).where("v is not null").select("answer_type", "v"))
    counts = rows.groupBy("answer_type").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v") == 0).alias("zeros"))
    return counts.join(upper_median(rows, "answer_type", "v"), "answer_type").select("answer_type", "n", "low", F.col("upper_median").alias("median"), "high", "zeros")


def question_distribution(questions: DataFrame, dimensions: tuple[str, ...] = ("answer_type", "shape", "hops"), unnamed: str = "unspecified") -> DataFrame:
    """dimension, value, n, share of all questions. One pass with grouping sets; what is null counts as ``unnamed``."""
    named = questions.select(*[F.coalesce(F.col(d).cast("string"), F.lit(unnamed)).alias(d) for d in dimensions])
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = named.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"is_{d}") for d in dimensions])
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        dimension, value = F.when(F.col(f"is_{d}") == 0, d).otherwise(dimension), F.when(F.col(f"is_{d}") == 0, F.col(d)).otherwise(value)
    rows = grouped.select(dimension.alias("dimension"), value.alias("value"), "n")
    whole = rows.where("dimension is null").select(F.col("n").alias("total"))
    return rows.where("dimension is not null").join(F.broadcast(whole)).select("dimension", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def graph_health(tables: dict[str, DataFrame], projects: DataFrame, personnel: DataFrame) -> DataFrame:
    """metric, value: the rows of each table, and how much of the projects and people is linked."""
    counts = [df.agg(F.count("*").alias("value")).select(F.lit(f"rows of {name}").alias("metric"), "value") for name, df in tables.items()]

    def several(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        one = df.agg(F.create_map(*[x for name, value in metrics.items() for x in (F.lit(name), value.cast("long"))]).alias("m"))
        return one.select(F.explode("m").alias("metric", "value"))

    linked = several(projects, {
        "clients": F.count_distinct("client_name"), "project leads": F.count_distinct("project_lead"),
        "projects with value": F.count_if(F.col("contract_value") > 0), "projects with date": F.count("completion_date"),
    })
    out = linked.unionByName(several(personnel, {"certified engineers": F.count_distinct("engineer_name")}))
    for count in counts:
        out = out.unionByName(count)
    return out


def is_healthy(health: DataFrame) -> DataFrame:
    """One row: whether there are clients and projects with a value."""
    return health.agg((F.count_if(F.col("metric").isin("clients", "projects with value") & (F.col("value") > 0)) == 2).alias("healthy"))


def log_audit(log: DataFrame, index: DataFrame) -> DataFrame:
    """part, value, n: statuses of a log (doc_id, status, bad), its errors and bad lines, and which of an index (doc_id) it lacks."""
    lines = log.where(~F.col("bad"))
    status = F.coalesce("status", F.lit("UNKNOWN"))
    by_status = lines.groupBy(status.alias("value")).agg(F.count("*").alias("n")).select(F.lit("status").alias("part"), "value", "n")
    totals = log.agg(F.count_if(~F.col("bad")).alias("records"), F.count_if("bad").alias("bad lines"), F.count_if(~F.col("bad") & status.isin("ERROR", "FAILED")).alias("errors"))
    totals = totals.select(F.explode(F.create_map(*[x for name in ("records", "bad lines", "errors") for x in (F.lit(name), F.col(f"`{name}`"))])).alias("value", "n")).select(F.lit("log").alias("part"), "value", "n")
    indexed = index.select("doc_id").where("doc_id is not null").distinct()
    logged = lines.select("doc_id").where("doc_id is not null").distinct()
    both = indexed.withColumn("i", F.lit(1)).join(logged.withColumn("l", F.lit(1)), "doc_id", "full_outer")
    parity = both.agg(F.count("i").alias("indexed"), F.count("l").alias("logged"), F.count_if(F.col("l").isNull()).alias("unlogged"))
    parity = parity.select(F.explode(F.create_map(*[x for name in ("indexed", "logged", "unlogged") for x in (F.lit(name), F.col(name))])).alias("value", "n")).select(F.lit("index").alias("part"), "value", "n")
    return by_status.unionByName(totals).unionByName(parity)


def text_lengths(sheets: DataFrame) -> DataFrame:
    """doc_id, characters of all cells of a workbook's rows (doc_id, value), null cells counting nothing."""
    return sheets.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters"))
