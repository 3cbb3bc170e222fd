"""The primary solver: fifteen shapes of questions, answered together.

Questions are rows. A question's gate (answer type and keywords) says which shapes it can have; all aggregates over a
client's works are worked out in one grouping for all questions that share their parameters, those over an engineer's in
another, and the first shape, in order, whose gate fits and whose answer is known gives the answer. What no shape answers gets the default of its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basic import found, has_any, once
from ..functions.dates import years_named
from ..functions.money import amount_of, bare_amount, number_in_words, unit_of
from ..functions.names import category_of_name
from ..operators.contain import contained_pairs
from ..operators.lineage import cut, shuffled
from ..operators.works import largest_gap, package_maxima, portfolio_primary, referenced

ANCHOR = "2021-03-10"
# The answers where no shape fits.
DEFAULTS = {"money": 100_000_000.0, "percent": 50.0, "count": 1.0, "days": 100.0}
# Gates, in their order: shape, answer type (None: any), keywords, keywords that must be absent.
GATES = (
    ("exclusion_aggregate", "money", ("excluding", "remove", "minus"), ()),
    ("collection_pct", "percent", ("collection", "billed to the client", "billed", "invoiced"), ("reference", "testimonial")),
    ("referenced_share", "percent", ("reference letter", "formal verification", "carry formal verification", "divided by the total", "testimonial"), ()),
    ("absence", "count", ("no client reference", "lack a client reference", "unreferenced", "no reference"), ()),
    ("billing_gap", "money", ("shortfall", "unbilled remainder", "gap between what", "amount after we cross-check", "awarded and the amount we have actually invoiced", "sanctioned and what we've billed"), ()),
    ("year_gap", "money", ("between 20", "moved between", "gap between the 20", "variance between that 20"), ()),
    ("mean_median_gap", "money", ("mean and the median", "avg and median", "mean against the median", "average and median"), ()),
    ("threshold_aggregate", "money", ("clear the", "cutoff", "limit", "at or over the", "exceed the", "crossing the", "hitting the", "above", "meet or exceed"), ()),
    ("date_span", "days", (), ()),
    ("distinct_count", "count", ("categories", "distinct work", "classifications"), ()),
    ("temporal_chain", None, ("wrapped up after", "completed after", "after that date", "after her pmp", "after his pmp"), ()),
    ("hop_aggregate", "money", ("combined value of every completed assignment", "total value of all completed assignments", "delivered for", "delivered to that client", "trishakti work", "suvarna work"), ()),
    ("avg_work_size", "money", ("average size", "mean size", "defensible average", "overall average", "mean across all our finished work"), ()),
    ("gap_to_threshold", "money", ("reach our credential target", "additional work must we secure", "hit the", "reach the"), ()),
    ("rank_value_gap", "money", ("exceed the second largest", "largest work value and the second largest", "largest work exceed", "exceed the second-biggest", "exceeds the second"), ()),
)
# Words around an excluded term.
ARTICLES = ("the ", "a ", "an ")
TAILS = (" segment", " division", " scope", " sector", " category", " works", " piece", " side")
# Words of a question that name no project.
PLAIN_WORDS = ("days", "actually", "elapsed", "before", "project", "wrapped", "issued", "back", "march", "pretty", "sure")
# Patterns of the phrases that name an excluded term, a threshold and a target.
EXCLUDED = r"(?i)(?:excluding|remove|minus)\s+([A-Za-z0-9_\s]+?)(?:,|\s+what|\s+before|\s+so|\s*;|\s*—|\s*-|\s*\?|\s*:|\s*\.|\s*$)"
THRESHOLD = r"(?i)(?:clear the|cutoff|limit|at or over the|exceed the|crossing the|hitting the|above|meet or exceed)\s+(?:against the\s+)?([A-Za-z0-9.\-\s]+?)(?:mark|cutoff|limit|line|threshold|$|,)"
TARGET = r"(?i)(?:target of|target|bar|hit the|reach the)\s*(?:INR|Rs\.?)?\s*([\d,]+(?:\.\d+)?|\w+)\s*(Cr|Crore|Lakh|mark)?"


def gate(question: Column, kind: Column, name: str) -> Column:
    """Whether a question can have a shape."""
    return _passes(F.lower(question), kind, name)


def _passes(low: Column, kind: Column, name: str) -> Column:
    """``gate`` of a question in lower case; the type comes first, for it spares the words of most gates."""
    _, of_kind, words, absent = next(g for g in GATES if g[0] == name)
    fits = F.coalesce(kind == of_kind, F.lit(False)) if of_kind else F.lit(True)
    if words:
        fits = fits & has_any(low, words)
    return fits & ~has_any(low, absent) if absent else fits


def excluded_term(question: Column) -> Column:
    term = F.lower(F.trim(found(question, EXCLUDED)))
    for article in ARTICLES:
        term = F.trim(F.regexp_replace(term, f"^{article}", ""))
    for tail in TAILS:
        term = F.trim(F.regexp_replace(term, f"{tail}$", ""))
    return term


def amount(phrase: Column) -> Column:
    """A non-zero amount, in digits or in words."""
    some = lambda n: F.nullif(n, F.lit(0.0))
    # ``parse_money`` with its steps worked out once
    money = once(bare_amount(phrase), lambda bare: once(unit_of(bare), lambda unit: once(amount_of(bare, unit), some)))
    return F.coalesce(money, once(number_in_words(phrase), some))


def whole(value: Column) -> Column:
    return F.bround(value.cast("double"), 0)


def _looked_up(rows: DataFrame, key: Column, other: DataFrame, on: Column) -> DataFrame:
    """``rows`` left-joined with ``other``; those without a key, of which there may be very many, are not dealt out at all."""
    without = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema]
    return rows.where(key.isNotNull()).join(shuffled(other), on, "left").unionByName(rows.where(key.isNull()).select("*", *without))


def _parameters(questions: DataFrame) -> DataFrame:
    """What the solver takes from a question's text, in its place: the gates that it passes as bits, and what only a gate's own shape reads."""
    text, kind = F.col("question"), F.col("answer_type")
    # bound as a pair, so that the many tests of words stay out of the generated code, which would be too long to be compiled
    bits = once(F.struct(F.lower(text).alias("low"), kind.alias("kind")), lambda x: sum((F.when(_passes(x["low"], x["kind"], name), F.lit(1 << i)).otherwise(0) for i, (name, *_) in enumerate(GATES)), F.lit(0)))
    questions = questions.withColumn("gates", bits)
    fits = {name: F.col("gates").bitwiseAND(F.lit(1 << i)) != 0 for i, (name, *_) in enumerate(GATES)}
    years = years_named(text)
    two = fits["year_gap"] & (F.size(years) >= 2)
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+)\b"), F.lit(1)), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*PLAIN_WORDS))
    return questions.select(
        "qid", "answer_type", "client", "engineer", "package", "gates", F.when(fits["exclusion_aggregate"], excluded_term(text)).alias("term"),
        F.when(two, years[0]).alias("year1"), F.when(two, years[1]).alias("year2"), F.when(fits["threshold_aggregate"], amount(F.trim(found(text, THRESHOLD)))).alias("threshold"),
        F.when(fits["gap_to_threshold"], amount(F.concat_ws(" ", found(text, TARGET, 1), found(text, TARGET, 2)))).alias("goal"), F.when(kind == "days", words).alias("words"),
    )


def _first(condition: Column, value: str) -> Column:
    """The value of the row with the smallest doc_id, of those that meet a condition."""
    return F.min(F.when(condition, F.struct("doc_id", value)))[value]


def _after(since: DataFrame, works: DataFrame) -> DataFrame:
    """_lead, after_sum: the values v of works (_lead, day, v), each as often as a day of ``since`` (_lead, day) lies before its own.

    Both meet day by day, one row for each: people who share a name do not meet every work under it.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    told = since.select("_lead", "day", F.lit(1).alias("n"), zero.alias("v")).unionByName(works.select("_lead", "day", F.lit(0).alias("n"), F.coalesce("v", zero).alias("v")))
    days = told.groupBy("_lead", "day").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_lead").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.withColumn("before", before.cast("decimal(10,0)")).groupBy("_lead").agg(F.sum(F.col("v") * F.col("before")).alias("after_sum"))


def solve(questions: DataFrame, certs: DataFrame, letters: DataFrame, receivables: DataFrame, personnel: DataFrame) -> DataFrame:
    """qid, shape and answer of every question.

    questions: qid, question, answer_type, client, engineer, package (as resolved; may be null). certs: doc_id,
    client_name, package_code, project_name, category, contract_value, completion_date (a date), project_lead.
    letters: package_code, issuing_client, contract_value. receivables: client_name, invoiced, received; those of one
    client add up. personnel: doc_id, engineer_name, issue_date and, where people share a name, employee_id: such a name
    stands for each of them, so what was completed after the certificates of several counts for each.
    """
    return solved(questions, certs, letters, receivables, personnel).select("qid", "shape", "answer")


def solved(questions: DataFrame, certs: DataFrame, letters: DataFrame, receivables: DataFrame, personnel: DataFrame) -> DataFrame:
    """``solve`` with the question's client, engineer and package beside its answer.

    Questions are read once, and what they need is kept without their texts. Works are met once for each client and set of
    parameters, not for each question, and a question meets only the tables for which it has a key.
    """
    asked = cut(_parameters(questions))
    dated = F.col("completion_date").isNotNull()
    by_package = certs.where("package_code is not null").groupBy(F.lower("package_code").alias("_package")).agg(_first(F.col("client_name").isNotNull(), "client_name").alias("_package_client"), _first(dated, "completion_date").alias("_p_date"))
    q = _looked_up(asked, F.col("package"), by_package, F.lower("package") == F.col("_package"))
    q = q.withColumn("target", F.coalesce("client", "_package_client"))

    # only the portfolios of clients that questions are about are made
    parameters = ["term", "year1", "year2", "threshold"]
    about = q.where("target is not null").select("target", *parameters).distinct().withColumn("_asked", F.lower("target"))
    own = certs.where("client_name is not null").join(shuffled(about.select("_asked").distinct()), F.lower("client_name") == F.col("_asked"), "left_semi")
    works = referenced(portfolio_primary(own), letters)
    works = works.select(F.lower("client_name").alias("_works_of"), "contract_value", "completion_date", "referenced", F.lower(F.coalesce("category", F.lit(""))).alias("_category"), F.lower(F.coalesce("project_name", F.lit(""))).alias("_name"))
    works = cut(works)  # and so on: what each table was dealt out for is gone from the disk before the next is made
    zero = F.lit(0).cast("decimal(18,2)")
    value = F.coalesce(F.col("contract_value").cast("decimal(18,2)"), zero)  # sums are exact, whatever order rows come in
    stem = F.nullif(F.regexp_replace("term", "s+$", ""), F.lit(""))
    dropped = F.lit(False)
    for part in (stem, F.col("term")):
        for place in ("_category", "_name"):
            dropped = dropped | F.contains(F.col(place), part)
    dropped = F.coalesce(stem.isNotNull() & dropped, F.lit(False))
    joined = about.join(shuffled(works), F.col("_asked") == F.col("_works_of"), "left")
    about = joined.groupBy("_asked", "target", *parameters).agg(
        F.sum(F.when(dropped, zero).otherwise(value)).alias("kept_sum"),
        F.sum(value).alias("sum"),
        (F.sum(value).cast("double") / F.nullif(F.count("contract_value"), F.lit(0))).alias("mean"),
        F.median("contract_value").alias("median"),
        F.count("_works_of").alias("works"),
        F.count_if("referenced").alias("with_letter"),
        F.sum(F.when(F.year("completion_date") == F.col("year1"), value).otherwise(zero)).alias("sum1"),
        F.sum(F.when(F.year("completion_date") == F.col("year2"), value).otherwise(zero)).alias("sum2"),
        F.sum(F.when(value >= F.col("threshold"), value).otherwise(zero)).alias("sum_above"),
    )
    gaps = largest_gap(works, ["_works_of"], "contract_value", "lead_gap")
    about = about.join(shuffled(gaps), F.col("_asked") == F.col("_works_of"), "left").drop("_works_of")
    finished = certs.where("client_name is not null").groupBy(F.lower("client_name").alias("_c")).agg(_first(dated, "completion_date").alias("_c_date"))
    about = about.join(shuffled(finished), F.col("_asked") == F.col("_c"), "left").drop("_c", "_asked")
    owed = receivables.groupBy(F.col("client_name").alias("_billed")).agg(F.sum("invoiced").alias("invoiced"), F.sum("received").alias("received"))
    about = about.join(shuffled(owed), F.col("target") == F.col("_billed"), "left").drop("_billed")
    about = cut(about.select(*[F.col(c).alias(f"_{c}" if c in ("target", *parameters) else c) for c in about.columns]))

    engineers = asked.where("engineer is not null").select(F.lower("engineer").alias("_engineer")).distinct()
    led = certs.where("project_lead is not null").select(
        F.lower("project_lead").alias("_lead"), "doc_id", "package_code", "contract_value", "completion_date", F.coalesce(F.lower(F.nullif("category", F.lit(""))), category_of_name(F.col("project_name"))).alias("c")
    )
    led = led.join(shuffled(engineers), F.col("_lead") == F.col("_engineer"), "left_semi")
    facts = led.groupBy("_lead").agg(F.count_distinct("c").alias("categories"))
    ends = led.groupBy("_lead").agg(_first(dated, "completion_date").alias("_l_date"))
    people = personnel if "employee_id" in personnel.columns else personnel.withColumn("employee_id", F.lit(None).cast("string"))
    issued = people.where("issue_date is not null and engineer_name is not null").groupBy(F.lower("engineer_name").alias("_lead"), "employee_id").agg(F.min(F.struct("doc_id", "issue_date"))["issue_date"].alias("issued"))
    since = engineers.select(F.col("_engineer").alias("_lead")).join(shuffled(issued), "_lead", "left").select("_lead", F.coalesce("issued", F.to_date(F.lit(ANCHOR))).alias("day"))
    after_sum = _after(since, package_maxima(led, ["_lead"]).select("_lead", F.col("completion_date").alias("day"), F.col("contract_value").cast("decimal(18,2)").alias("v")))
    by_engineer = engineers.withColumnRenamed("_engineer", "_lead").join(shuffled(after_sum), "_lead", "left")
    by_engineer = by_engineer.join(shuffled(facts), "_lead", "left").join(shuffled(ends), "_lead", "left")

    q = _looked_up(q, F.col("engineer"), by_engineer, F.lower("engineer") == F.col("_lead"))
    same = F.col("target") == F.col("_target")
    for name in parameters:
        same &= F.col(name).eqNullSafe(F.col(f"_{name}"))
    q = _looked_up(q, F.col("target"), about, same)

    has_client, has_engineer = F.col("client").isNotNull(), F.col("engineer").isNotNull()
    end = F.coalesce("_p_date", "_l_date", F.when(has_client, F.col("_c_date")))
    answers = {
        "exclusion_aggregate": F.when(has_client, whole(F.coalesce("kept_sum", F.lit(0.0)))),
        "collection_pct": F.when(F.col("invoiced") > 0, F.round((F.col("received").cast("double") / F.nullif(F.col("invoiced").cast("double"), F.lit(0.0)) * 100).cast("decimal(20,8)"), 2).cast("double")),
        "referenced_share": F.round((F.col("with_letter") * 100 / F.nullif("works", F.lit(0))).cast("decimal(20,8)"), 2).cast("double"),
        "absence": F.when(has_client, (F.coalesce(F.col("works") - F.col("with_letter"), F.lit(0))).cast("double")),
        "billing_gap": F.when(has_client, whole(F.abs(F.coalesce("sum", zero) - F.coalesce(F.col("invoiced").cast("decimal(28,2)"), zero)))),
        "year_gap": F.when(has_client & F.col("year2").isNotNull(), whole(F.abs(F.coalesce("sum1", zero) - F.coalesce("sum2", zero)))),
        "mean_median_gap": whole(F.col("mean") - F.col("median")),
        "threshold_aggregate": F.when(has_client & F.col("threshold").isNotNull(), whole(F.coalesce("sum_above", F.lit(0.0)))),
        "date_span": F.abs(F.datediff("end", F.to_date(F.lit(ANCHOR)))).cast("double"),
        "distinct_count": F.when(has_engineer, F.coalesce("categories", F.lit(0)).cast("double")),
        "temporal_chain": F.when(has_engineer, whole(F.coalesce("after_sum", F.lit(0.0)))),
        "hop_aggregate": F.when(has_client, whole(F.coalesce("sum", F.lit(0.0)))),
        "avg_work_size": whole(F.col("mean")),
        "gap_to_threshold": F.when(has_client & F.col("goal").isNotNull(), whole(F.greatest(F.lit(0.0), F.col("goal") - F.coalesce("sum", F.lit(0.0))))),
        "rank_value_gap": F.when(has_client, whole(F.col("lead_gap"))),
    }
    default = F.lit(0.0)
    for kind, stock in DEFAULTS.items():
        default = F.when(F.col("answer_type") == kind, stock).otherwise(default)

    def chosen(rows: DataFrame) -> DataFrame:
        tries = [F.when((F.col("gates").bitwiseAND(F.lit(1 << i)) != 0) & answers[name].isNotNull(), F.struct(F.lit(name).alias("shape"), answers[name].cast("double").alias("answer"))) for i, (name, *_) in enumerate(GATES)]
        picked = F.coalesce(*tries, F.struct(F.lit("fallback").alias("shape"), default.alias("answer")))
        return rows.select("qid", "client", "engineer", "package", "answer_type", "words", "end", picked.alias("c"))

    q = cut(chosen(q.withColumn("end", end)))
    # where nothing else tells a date, a word of the question in a project's name: the first such word, then the smallest doc_id
    undated = (F.col("answer_type") == "days") & F.col("end").isNull()
    asked = q.where(undated).select("qid", F.posexplode("words").alias("_at", "_word")).withColumn("_word", F.lower("_word"))
    out = q.select("qid", "client", "engineer", "package", "c.shape", "c.answer")
    if asked.isEmpty():
        return out
    named = certs.where("project_name is not null and completion_date is not null").select("doc_id", F.lower("project_name").alias("_low"), "completion_date")
    pairs = contained_pairs(named.select(F.col("_low").alias("id"), F.col("_low").alias("text")).distinct(), asked.select(F.col("_word").alias("name")))
    first = pairs.join(named, pairs["id"] == named["_low"]).groupBy(F.col("name").alias("_word")).agg(F.min(F.struct("doc_id", "completion_date")).alias("_first"))
    by_word = asked.join(first, "_word").groupBy("qid").agg(F.min_by("_first.completion_date", "_at").alias("_w_date"))
    # no gate before that of a date_span fits a question about days
    spanned = F.col("_w_date").isNotNull()
    found_q = q.where(undated).join(shuffled(by_word), "qid", "left").withColumn("_span", F.abs(F.datediff("_w_date", F.to_date(F.lit(ANCHOR)))).cast("double"))
    found_q = found_q.select("qid", "client", "engineer", "package", F.when(spanned, "date_span").otherwise(F.col("c.shape")).alias("shape"), F.when(spanned, F.col("_span")).otherwise(F.col("c.answer")).alias("answer"))
    return q.where(~F.coalesce(undated, F.lit(False))).select(out.columns[0], *out.columns[1:4], "c.shape", "c.answer").unionByName(found_q)
