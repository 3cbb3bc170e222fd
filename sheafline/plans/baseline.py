"""The baseline solver: eleven shapes by keyword, with stock values where a question names nothing known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import bounded
from ..functions.basic import found, has_any
from ..functions.dates import question_date
from ..functions.money import money_mentions
from ..functions.names import category_before_dash
from ..operators.contain import contained_pairs
from ..operators.lineage import shuffled
from ..operators.works import engineer_works, first_certification, largest_gap, portfolio_baseline, top_row

# Shapes by keywords, in their order.
SHAPES = (
    ("absence", ("no client reference", "lack a client reference", "no reference letter", "without reference")),
    ("date_span", ("days passed", "interval from", "days actually elapsed", "number of days", "how many days")),
    ("distinct_count", ("distinct", "different categories", "classifications")),
    ("temporal_chain", ("after that date", "after her pmp", "after his pmp", "after certification")),
    ("avg_work_size", ("average size", "mean size")),
    ("exclusion_aggregate", ("excluding", "exclude")),
    ("gap_to_threshold", ("additional work", "reach our credential target", "gap between")),
    ("rank_value", ("largest", "second largest")),
    ("referenced_share", ("share of completed", "divided by the total", "collection figure", "collection percentage", "collected against")),
    ("threshold_aggregate", ("crossing", "hitting the", "above", "over")),
)
# Stock answers.
COLLECTION = 88.5
STOCK = {
    "absence": 1.0, "date_span": 730.0, "distinct_count": 3.0, "hop_aggregate": 5e8, "temporal_chain": 2.5e8, "avg_work_size": 2e8, "exclusion_aggregate": 5e8,
    "gap_to_threshold": 2.5e7, "rank_value": 5e7, "referenced_share": 50.0, "threshold_aggregate": 5e8,
}
THRESHOLD, GOAL = 5e7, 2e8
MONEY_SHAPES = ("avg_work_size", "exclusion_aggregate", "gap_to_threshold", "rank_value", "threshold_aggregate", "temporal_chain")


def infer_shape(question: Column, kind: Column) -> Column:
    """The first shape whose keywords occur; hop_aggregate if none does."""
    text = F.lower(question)
    chosen = F.lit("hop_aggregate")
    for name, words in reversed(SHAPES):
        fits = has_any(text, words)
        if name == "date_span":
            fits = fits & F.coalesce(kind == "days", F.lit(False))
        if name == "rank_value":
            fits = F.contains(text, F.lit("largest")) & F.contains(text, F.lit("second largest"))
        chosen = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(chosen)
    return chosen


def route(question: Column, kind: Column, shape: Column) -> Column:
    """What is worked out: by the answer's type first, then by the shape."""
    text = F.lower(question)
    return (
        F.when(kind == "percent", F.when(has_any(text, ("collection", "billed", "collected")), "collection").otherwise("referenced_share"))
        .when(kind == "days", "date_span")
        .when(kind == "count", F.when(shape.isin("distinct_count", "absence"), shape).otherwise("three"))
        .otherwise(F.when(shape.isin(*MONEY_SHAPES), shape).otherwise("hop_aggregate"))
    )


def named_entity(questions: DataFrame, names: DataFrame, parts: bool) -> DataFrame:
    """qid and the longest name that the question contains; else, with ``parts``, one whose beginning, up to a comma or dash, it contains."""
    names = names.where("name is not null and name <> ''").select("name").distinct()
    names = names.select("name", F.lower("name").alias("low"), F.lower(F.trim(F.regexp_extract("name", r"^[\s,—–-]*([^,—–-]+)", 1))).alias("start"))
    keys = names.select("name", F.col("low").alias("key"), F.lit(True).alias("_whole"))
    keys = keys.unionByName(names.where("start <> '' and start <> low").select("name", F.col("start").alias("key"), F.lit(False).alias("_whole"))) if parts else keys
    pairs = contained_pairs(questions.select(F.col("qid").alias("id"), F.lower("question").alias("text")), keys.select(F.col("key").alias("name")))
    hits = pairs.select(F.col("id").alias("qid"), F.col("name").alias("key")).join(shuffled(keys), "key")
    return top_row(hits, ["qid"], [F.col("_whole").desc(), F.when(F.col("_whole"), F.length("name")).desc_nulls_last(), F.col("name")]).select("qid", "name")


def _exact(value: str) -> Column:
    """A value as a decimal, 0 where it is not known: sums do not depend on the order of rows."""
    return F.coalesce(F.col(value).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def solve(questions: DataFrame, certs: DataFrame, letters: DataFrame, personnel: DataFrame) -> DataFrame:
    """qid, shape, answer (within its bounds) of every question; tables as for the primary solver, certs with doc_type.

    A null question gets the stock answer of its shape. No table is sent through the driver whole.
    """
    clients = named_entity(questions, certs.select(F.col("client_name").alias("name")), True).withColumnRenamed("name", "_client")
    engineers = named_entity(questions, personnel.select(F.col("engineer_name").alias("name")), False).withColumnRenamed("name", "_engineer")
    shape = F.coalesce("shape", infer_shape(F.col("question"), F.col("answer_type"))) if "shape" in questions.columns else infer_shape(F.col("question"), F.col("answer_type"))
    q = questions.withColumn("_shape", shape).select("qid", "question", "answer_type", F.col("_shape").alias("shape"))
    q = q.join(shuffled(clients), "qid", "left").join(shuffled(engineers), "qid", "left")
    mentions = money_mentions(F.col("question"))
    q = q.withColumns({"asked_date": question_date(F.col("question")), "first_amount": F.try_element_at(mentions, F.lit(1))["value"], "term": F.lower(F.trim(found(F.col("question"), r"(?i)excluding\s+([a-zA-Z\s]+?)(?:[,;—–-]|\s+what|\s+before)")))})
    led = engineer_works(certs.where("project_lead is not null")).withColumn("_lead", F.lower("project_lead"))
    first_led = top_row(led, ["_lead"], [F.col("completion_date").asc_nulls_first(), F.col("doc_id")]).select("_lead", F.col("client_name").alias("_led_client"))
    q = q.join(shuffled(first_led), F.lower("_engineer") == F.col("_lead"), "left").drop("_lead")
    certified = first_certification(personnel).select(F.lower("engineer_name").alias("_certified"), F.col("issue_date").alias("_issued"))
    q = q.join(shuffled(certified), F.lower("_engineer") == F.col("_certified"), "left").withColumn("since", F.coalesce("asked_date", "_issued"))

    works = portfolio_baseline(certs.where("client_name is not null")).select(F.lower("client_name").alias("_of"), _exact("contract_value").alias("v"), F.lower(F.coalesce("project_name", F.lit(""))).alias("_name"))
    value = F.col("v")
    nothing = F.lit(0).cast("decimal(18,2)")
    joined = q.join(shuffled(works), F.lower("_client") == F.col("_of"))
    of_client = joined.groupBy("qid").agg(
        F.count("*").alias("works"),
        F.sum(value).alias("sum"),
        F.sum(F.when(F.coalesce(F.contains("_name", "term"), F.lit(False)), nothing).otherwise(value)).alias("kept_sum"),
        F.sum(F.when(value >= F.coalesce("first_amount", F.lit(THRESHOLD)), value).otherwise(nothing)).alias("sum_above"),
        F.max("v").alias("top"),
    )
    of_client = of_client.join(shuffled(largest_gap(joined, ["qid"], "v", "top_gap")), "qid", "left")
    averages = q.select("qid", F.coalesce("_client", "_led_client").alias("_for")).join(shuffled(works), F.lower("_for") == F.col("_of")).groupBy("qid").agg(F.avg(F.nullif(value, nothing)).alias("mean"))
    letter_counts = letters.groupBy(F.lower("issuing_client").alias("_issuer")).agg(F.count_distinct("project_name").alias("letters"))
    led_values = led.select("_lead", F.lower("client_name").alias("_led_for"), _exact("contract_value").alias("v"), "completion_date", F.lower(category_before_dash(F.col("project_name"))).alias("_kind"))
    of_lead = q.join(shuffled(led_values), F.lower("_engineer") == F.col("_lead")).groupBy("qid").agg(
        F.count("*").alias("led"),
        F.sum("v").alias("led_sum"),
        F.count_if(F.contains("_led_for", F.lower("_client"))).alias("both"),
        F.sum(F.when(F.contains("_led_for", F.lower("_client")), F.col("v"))).alias("both_sum"),
        F.sum(F.when(F.col("completion_date") > F.col("since"), F.col("v")).otherwise(nothing)).alias("after_sum"),
        F.count_distinct(F.nullif("_kind", F.lit(""))).alias("kinds"),
    )
    projects = certs.where("completion_date is not null and nullif(trim(project_name), '') is not null").select("doc_id", "completion_date", F.explode(F.array_distinct(F.concat(F.array("project_name"), F.split("project_name", "—")))).alias("_part"))
    dated = q.where("answer_type = 'days'").select(F.col("qid").alias("id"), F.lower("question").alias("text"))
    named = contained_pairs(dated, projects.select(F.lower("_part").alias("name"))).select(F.col("id").alias("qid"), F.col("name").alias("_low"))
    ends = named.join(shuffled(projects.withColumn("_low", F.lower("_part"))), "_low").groupBy("qid").agg(F.min_by("completion_date", "doc_id").alias("_end"))
    q = q.join(shuffled(of_client), "qid", "left").join(shuffled(averages), "qid", "left").join(shuffled(of_lead), "qid", "left").join(shuffled(ends), "qid", "left").join(shuffled(letter_counts), F.lower("_client") == F.col("_issuer"), "left")

    has_client, has_engineer = F.col("_client").isNotNull(), F.col("_engineer").isNotNull()
    zero = F.lit(0.0)
    n_letters = F.coalesce("letters", F.lit(0))
    answers = {
        "absence": F.when(has_client, F.greatest(zero, F.coalesce("works", F.lit(0)) - n_letters)),
        "date_span": F.abs(F.datediff("_end", "since")).cast("double"),
        "distinct_count": F.when(has_engineer, F.greatest(F.lit(1), F.coalesce("kinds", F.lit(0))).cast("double")),
        "hop_aggregate": F.coalesce(F.when(has_engineer & has_client & (F.col("both") > 0), F.col("both_sum")), F.when(F.col("works") > 0, F.col("sum")), F.when(F.col("led") > 0, F.col("led_sum"))),
        "temporal_chain": F.when(has_engineer & F.col("since").isNotNull() & (F.col("after_sum") > 0), F.col("after_sum")),
        "avg_work_size": F.bround(F.col("mean").cast("double"), 0),
        "exclusion_aggregate": F.when(has_client, F.coalesce("kept_sum", zero)),
        "gap_to_threshold": F.when(has_client, F.greatest(zero, F.coalesce("first_amount", F.lit(GOAL)) - F.coalesce("sum", zero))),
        "rank_value": F.when(F.col("works") >= 2, F.col("top_gap")).when(F.col("works") == 1, F.col("top")),
        "referenced_share": F.when(F.col("works") > 0, n_letters * 100.0 / F.nullif("works", F.lit(0))),
        "threshold_aggregate": F.when(has_client, F.coalesce("sum_above", zero)),
    }
    way = route(F.col("question"), F.col("answer_type"), F.col("shape"))
    answer = F.when(way == "collection", COLLECTION).when(way == "three", 3.0)
    for name, expression in answers.items():
        answer = answer.when(way == name, F.coalesce(expression.cast("double"), F.lit(STOCK[name])))
    return q.select("qid", "shape", bounded(answer, F.col("answer_type")).alias("answer"))
