"""Checks of a set of answers, and its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import is_fraction, issues, repaired, score_one, submitted_number, valid_number
from .works import last_write_wins, top_row

ERRORS = ("INVALID_NUMBER", "OUT_OF_BOUNDS_PERCENT", "NEGATIVE_DAYS", "NEGATIVE_COUNT", "NEGATIVE_MONEY", "MISSING_QUESTION_ID")
# Buckets of the score histogram, from the best.
BUCKETS = ("exact", "95-99.9%", "80-94.9%", "50-79.9%", ">0-49.9%", "zero")


def set_issues(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Ids that are missing or unexpected: qid, code."""
    q, a = questions.select("qid").distinct(), answers.select("qid").distinct()
    missing = q.join(a, "qid", "left_anti").withColumn("code", F.lit("MISSING_QUESTION_ID"))
    return missing.unionByName(a.join(q, "qid", "left_anti").withColumn("code", F.lit("UNEXPECTED_QUESTION_ID")))


def validate(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """All issues of a set of answers: qid, code, severity. questions: qid, answer_type. answers: qid, raw_answer, row_num."""
    last = last_write_wins(answers)
    typed = questions.join(last, "qid").select("qid", F.explode(issues(valid_number(F.col("raw_answer")), F.col("answer_type"))).alias("code"))
    repeated = last.where("duplicated").select("qid", F.lit("DUPLICATE_QID_ROW").alias("code"))
    every = typed.unionByName(repeated).unionByName(set_issues(questions, answers))
    return every.withColumn("severity", F.when(F.col("code").isin(*ERRORS), "ERROR").otherwise("WARNING"))


def validation_summary(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: expected, found, errors, warnings, passes, is_valid."""
    found = validate(questions, answers)
    counts = found.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_distinct(F.when(F.col("severity") == "ERROR", F.col("qid"))).alias("bad"))
    sizes = questions.join(answers.select("qid").distinct().withColumn("_has", F.lit(1)), "qid", "left").agg(F.count("*").alias("expected"), F.count("_has").alias("found"))
    return sizes.join(counts).select("expected", "found", "errors", "warnings", (100.0 * (F.col("expected") - F.col("bad")) / F.nullif("expected", F.lit(0))).alias("pass_rate"), (F.col("errors") == 0).alias("is_valid"))


def type_statistics(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """answer_type, total, valid, zeros, sum."""
    v = valid_number(F.col("raw_answer"))
    rows = questions.join(last_write_wins(answers), "qid").withColumn("v", v)
    return rows.groupBy(F.coalesce("answer_type", F.lit("unknown")).alias("answer_type")).agg(F.count("*").alias("total"), F.count("v").alias("valid"), F.count_if(F.col("v") == 0).alias("zeros"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"))


def mode_with_count(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value, the smallest of equals, and its count: one row."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), F.col(value)).limit(1)


#: Half the share of rows around the middle that is sorted, well above the error of the sketch that bounds it.
AROUND, SKETCH = 0.001, 20_000


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, upper_median: of n values in order the one at place n div 2 + 1; nulls do not count.

    A sketch bounds the middle of each key; only the values between the bounds
    are put in order, those below are counted. A key may hold most of the rows.
    """
    rows = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("x"))
    ends = F.percentile_approx("x", [0.5 - AROUND, 0.5 + AROUND], SKETCH)
    bounds = rows.groupBy(key).agg(ends.alias("e"), F.count("*").alias("n")).select(key, "n", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    placed = rows.alias("r").join(bounds.alias("b"), F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))).select(f"r.{key}", "x", "n", "lo", "hi")
    counted = placed.where("x <= hi").groupBy(key, "n", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(F.col("x").asc_nulls_first()))  # what is below comes first, as one row
    at = F.floor(F.col("n") / 2) + 1
    found = counted.withColumn("upto", upto).where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at))
    return found.select(key, F.col("x").alias("upper_median"))


def file_issues(lines: DataFrame) -> DataFrame:
    """qid (``HEADER``), code, severity of a file of answers as a whole, from its lines (row_num, line): empty, or without the usual heading."""
    kept = lines.where("trim(line) <> ''")
    cells = F.transform(F.split(F.lower("line"), ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    titled = F.array_contains(cells, "question_id") | F.array_contains(cells, "qid")
    first = kept.agg(F.min_by(titled, "row_num").alias("titled"))
    code = F.when(F.col("titled").isNull(), "EMPTY_FILE").when(~F.col("titled"), "MISSING_STANDARD_HEADER")
    found = first.select(F.lit("HEADER").alias("qid"), code.alias("code")).where("code is not null")
    return found.withColumn("severity", F.when(F.col("code") == "EMPTY_FILE", "ERROR").otherwise("WARNING"))


def anomalies(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """code, value of what is odd about the whole set: one value too often, too many zeros, fractions among percentages."""
    rows = questions.join(last_write_wins(answers), "qid").withColumn("v", valid_number(F.col("raw_answer")))
    sizes = rows.agg(F.count("v").alias("n"), F.count_if(F.col("v") == 0).alias("zeros"), F.count_if((F.col("answer_type") == "percent") & is_fraction(F.col("v"))).alias("fractions"))
    row = sizes.join(mode_with_count(rows, "v"), F.lit(True), "left")
    tests = [
        ("FREQUENT_VALUE", F.col("frequency") >= F.greatest(F.lit(15), F.floor(F.col("n") * 0.35)), F.col("v")),
        ("MANY_ZEROS", F.col("zeros") > 0.25 * F.col("n"), F.col("zeros").cast("double")),
        ("FRACTION_PERCENTS", F.col("fractions") >= 3, F.col("fractions").cast("double")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), value.alias("value"))) for code, test, value in tests]))
    return row.select(F.explode(found).alias("a")).select("a.code", "a.value")


def repair(questions: DataFrame, answers: DataFrame, rescale: bool = True) -> DataFrame:
    """A complete set of answers: every question once, in the order of the ids when written; unexpected ids are left out."""
    last = last_write_wins(answers).select("qid", valid_number(F.col("raw_answer")).alias("v"))
    return questions.join(last, "qid", "left").select("qid", repaired(F.col("v"), F.col("answer_type"), rescale).alias("answer"))


def scored(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions that count, with got, score, residual and error_pct. questions: qid, gold, shape, answer_type, hops, scored."""
    counted = questions.where(F.coalesce("scored", F.lit(True))) if "scored" in questions.columns else questions
    last = last_write_wins(answers).select("qid", submitted_number(F.col("raw_answer")).alias("got"))
    rows = counted.join(last, "qid", "left").withColumn("score", score_one(F.col("gold"), F.col("got")))
    return rows.withColumn("residual", F.col("got") - F.col("gold")).withColumn("error_pct", F.when(F.col("gold") != 0, F.abs(F.col("got") - F.col("gold")) / F.nullif(F.abs(F.col("gold")), F.lit(0.0)) * 100))


def bucket(score: Column) -> Column:
    return F.when(score >= 1, BUCKETS[0]).when(score >= 0.95, BUCKETS[1]).when(score >= 0.8, BUCKETS[2]).when(score >= 0.5, BUCKETS[3]).when(score > 0, BUCKETS[4]).otherwise(BUCKETS[5])


def histogram(rows: DataFrame) -> DataFrame:
    """bucket, count, with empty buckets."""
    every = rows.sparkSession.createDataFrame([(i, b) for i, b in enumerate(BUCKETS)], "place int, bucket string")
    counts = rows.groupBy(bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counts, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("count"))


def breakdown(rows: DataFrame, dimensions: tuple[str, ...] = ("shape", "answer_type", "hops")) -> DataFrame:
    """Scores by each dimension and overall: dimension, value, score, questions, percentage. One pass with grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = rows.groupingSets(sets, *dimensions).agg(F.sum("score").alias("score"), F.count("*").alias("questions"), *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for d in dimensions:
        name, value = F.when(F.col(f"_{d}") == 0, d).otherwise(name), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "score", "questions", (100 * F.col("score") / F.col("questions")).alias("percentage"))


def extremes(rows: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The n worst answers below 1, and the first n exact ones by id."""
    return rows.where("score < 1").orderBy("score", "qid").limit(n), rows.where("score >= 1").orderBy("qid").limit(n)


def compare(baseline: DataFrame, candidate: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """qid, both answers, both scores and status. Inputs: qid, answer; gold: qid, gold."""
    rows = baseline.select("qid", F.col("answer").alias("base")).join(candidate.select("qid", F.col("answer").alias("cand")), "qid", "full_outer")
    rows = rows.join(gold.select("qid", "gold"), "qid", "left") if gold is not None else rows.withColumn("gold", F.lit(None).cast("double"))
    rows = rows.withColumns({"base_score": F.when(F.col("gold").isNotNull(), score_one(F.col("gold"), F.col("base"))), "cand_score": F.when(F.col("gold").isNotNull(), score_one(F.col("gold"), F.col("cand")))})
    delta = F.col("cand_score") - F.col("base_score")
    same = F.when(F.col("base").eqNullSafe(F.col("cand")), "UNCHANGED").otherwise("DIFFERENT")
    return rows.withColumn("status", F.when(delta > 1e-4, "IMPROVED").when(delta < -1e-4, "REGRESSED").otherwise(same))


def coverage(index: DataFrame, extracted: DataFrame, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_type, total, with_data, missing_fields: what of an index was extracted, and whether the required fields are there.

    extracted: doc_id and fields (a map from field to text).
    """
    wanted = F.array().cast("array<string>")
    for doc_type, fields in (required or {}).items():
        wanted = F.when(F.col("doc_type") == doc_type, F.array(*[F.lit(f) for f in fields])).otherwise(wanted)
    rows = index.select("doc_id", "doc_type").join(extracted.select("doc_id", "fields"), "doc_id", "left")
    lacking = F.exists(wanted, lambda f: F.try_element_at("fields", f).isNull())
    return rows.groupBy("doc_type").agg(F.count("*").alias("total"), F.count("fields").alias("with_data"), F.count_if(F.col("fields").isNotNull() & lacking).alias("missing_fields"))


def first_of_each(rows: DataFrame, kind: str, key: str, n: int) -> DataFrame:
    """A small sample that has every kind first: the first row of each kind by key, n of them."""
    return top_row(rows, [kind], [F.col(key)]).orderBy(kind).limit(n)
