"""Reports and text expressions on the driver's tables, each with the SQL that states the same.

A text expression reads texts that are made from a table's columns, by SQL that both engines read; what it must find
follows from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import dates, money, names, text
from .operators import quality, reports, resolve
from .plans import baseline, extract, primary
from .queries import _KIND, certificates, registering, table, typed_answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
query = registering(QUERIES, SQL)

# Sums of line items as answers: whole numbers, of which each type has good and bad ones.
_ANSWER = """CASE k WHEN 'money' THEN b WHEN 'percent' THEN b % 150 - 10 WHEN 'count' THEN b % 1000 / 2.0::DOUBLE ELSE b % 9000 - 50 END"""
_ASKED = f"SELECT o_orderkey AS qid, {_KIND} AS k, o_orderstatus AS status FROM orders"
_SUMS = "SELECT l_orderkey, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey"
_GIVEN = f"q AS ({_ASKED}), s AS ({_SUMS}), g AS (SELECT qid, k, CAST({_ANSWER} AS DOUBLE) AS v FROM q JOIN s ON qid = l_orderkey WHERE status <> 'P')"
_ODD = (
    ("money above the company's total", "k = 'money' AND v > 55300000000"), ("money below a thousand", "k = 'money' AND v <> 0 AND abs(v) < 1000"), ("percent out of range", "k = 'percent' AND (v < 0 OR v > 100)"),
    ("days out of range", "k = 'days' AND (v < 0 OR v > 7300)"), ("not whole", "k IN ('count', 'days') AND v <> floor(v)"), ("negative", "k IN ('count', 'money') AND v < 0"),
)
_ANY_ODD = " OR ".join(f"({test})" for _, test in _ODD)


def asked_and_given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions (orders that are not pending) and answers (all orders with line items)."""
    typed = typed_answers(spark, sf_dir).select("qid", "answer_type")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("bigint").alias("b"))
    b, k = F.col("b"), F.col("answer_type")
    value = F.when(k == "money", b.cast("double")).when(k == "percent", b % 150 - 10).when(k == "count", b % 1000 / 2).otherwise(b % 9000 - 50)
    answers = typed.join(sums, "qid").select("qid", value.cast("decimal(18,1)").cast("string").alias("raw_answer"), F.lit(1).alias("row_num"))
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qid"))
    return typed.join(open_, "qid"), answers


@query(
    f"""WITH {_GIVEN}, t AS (SELECT count(*) AS total FROM q WHERE status <> 'P'), x AS (SELECT count(*) AS extra FROM q JOIN s ON qid = l_orderkey WHERE status = 'P')
    SELECT total, (SELECT count(*) FROM g) AS answered, total - (SELECT count(*) FROM g) AS missing, extra, (SELECT count(*) FROM g WHERE {_ANY_ODD}) AS flagged, (SELECT count(*) FROM g WHERE NOT ({_ANY_ODD})) AS clean FROM t, x"""
)
def plausibility_report(spark, sf_dir):
    return reports.plausibility(*asked_and_given(spark, sf_dir))


@query(f"WITH {_GIVEN} " + " UNION ALL ".join("SELECT qid, k AS answer_type, v AS value, '" + code.replace("'", "''") + f"' AS code FROM g WHERE {test}" for code, test in _ODD))
def implausible_answers(spark, sf_dir):
    return reports.flagged(*asked_and_given(spark, sf_dir))


@query(f"WITH {_GIVEN}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS place, count(*) OVER (PARTITION BY k) AS n FROM g) SELECT k AS answer_type, max(n) AS n, min(v) AS low, max(v) FILTER (WHERE place = n // 2 + 1) AS median, max(v) AS high, count(*) FILTER (WHERE v = 0) AS zeros FROM r GROUP BY k")
def answer_distribution(spark, sf_dir):
    return reports.distribution_of_answers(*asked_and_given(spark, sf_dir))


@query(f"WITH {_GIVEN} SELECT o_orderkey AS qid, 'odd order ' || o_orderpriority AS why, o_orderstatus AS question, v AS value, g.qid IS NOT NULL AS answered FROM orders LEFT JOIN g ON o_orderkey = g.qid WHERE o_orderkey % 1000 = 1 AND o_orderstatus <> 'P'")
def canary_questions(spark, sf_dir):
    """Every thousandth order is watched; watching some questions is what the report is for."""
    asked, given = asked_and_given(spark, sf_dir)
    rows = table(spark, sf_dir, "orders")
    watched = rows.where("o_orderkey % 1000 = 1").select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("odd order "), "o_orderpriority").alias("why"))
    return reports.canaries(asked.join(rows.select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("question")), "qid"), given, watched)


@query(
    """WITH q AS (SELECT o_orderstatus AS a, o_orderpriority AS s, coalesce(CAST(nullif(o_orderkey % 4, 0) AS VARCHAR), 'unspecified') AS h FROM orders), n AS (SELECT count(*) AS total FROM q)
    SELECT d AS dimension, value, n, n / total::DOUBLE AS share FROM (SELECT 'answer_type' AS d, a AS value, count(*) AS n FROM q GROUP BY a UNION ALL SELECT 'shape', s, count(*) FROM q GROUP BY s UNION ALL SELECT 'hops', h, count(*) FROM q GROUP BY h), n"""
)
def question_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("answer_type"), F.col("o_orderpriority").alias("shape"), F.nullif(F.col("o_orderkey") % 4, F.lit(0)).alias("hops"))
    return reports.question_distribution(rows)


@query(
    """SELECT 'clients' AS metric, count(DISTINCT o_custkey) AS value FROM orders UNION ALL SELECT 'project leads', count(DISTINCT lead) FROM (SELECT min(l_suppkey) AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) UNION ALL SELECT 'projects with value', count(*) FILTER (WHERE o_totalprice > 0) FROM orders
    UNION ALL SELECT 'projects with date', count(o_orderdate) FROM orders UNION ALL SELECT 'certified engineers', count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'rows of projects', count(*) FROM orders UNION ALL SELECT 'rows of bills', count(*) FROM lineitem"""
)
def graph_health(spark, sf_dir):
    leads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_suppkey").cast("string").alias("project_lead"))
    works, people = certificates(spark, sf_dir).drop("project_lead").join(leads, "doc_id", "left"), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("engineer_name"))
    return reports.graph_health({"projects": works, "bills": table(spark, sf_dir, "lineitem")}, works, people)


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS d, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'UNKNOWN' ELSE event_type END AS s, value < 5 AS bad FROM events), ok AS (SELECT * FROM e WHERE NOT bad),
    i AS (SELECT CAST(c_custkey AS VARCHAR) AS d FROM customer)
    SELECT 'status' AS part, s AS value, count(*) AS n FROM ok GROUP BY s UNION ALL SELECT 'log', 'records', count(*) FROM ok UNION ALL SELECT 'log', 'bad lines', count(*) FROM e WHERE bad
    UNION ALL SELECT 'log', 'errors', count(*) FROM ok WHERE s IN ('ERROR', 'FAILED') UNION ALL SELECT 'index', 'indexed', count(DISTINCT d) FROM i UNION ALL SELECT 'index', 'logged', count(DISTINCT d) FROM ok
    UNION ALL SELECT 'index', 'unlogged', count(DISTINCT d) FROM i WHERE d NOT IN (SELECT d FROM ok)"""
)
def log_audit(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") != "click", F.col("event_type"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), status.alias("status"), (F.col("value") < 5).alias("bad"))
    return reports.log_audit(log, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id")))


_SAID = "CASE WHEN s_suppkey % 3 = 0 THEN 'works for Customer#' || lpad(CAST(s_suppkey * 7 AS STRING), 9, '0') || ' done' WHEN s_suppkey % 3 = 1 THEN ' #' || lpad(CAST(s_suppkey AS STRING), 9, '0') ELSE 'nobody' END"


@query(f"SELECT s_suppkey AS qid, min(c_name) AS client FROM (SELECT s_suppkey, lower(trim({_SAID})) AS t FROM supplier) LEFT JOIN customer ON contains(t, lower(c_name)) OR contains(lower(c_name), t) GROUP BY s_suppkey")
def find_clients(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.expr(_SAID).alias("text"))
    return resolve.find_clients(asked, table(spark, sf_dir, "customer").select(F.col("c_name").alias("client")))


@query(
    """WITH l AS (SELECT 'nations' AS file, n_nationkey AS r, n_name || ',1' AS line FROM nation UNION ALL SELECT 'blank', r_regionkey, repeat(' ', CAST(r_regionkey AS INT)) FROM region
        UNION ALL SELECT 'parts', p_partkey, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN 'x, "Question_ID" ,answer' ELSE p_name END FROM part),
    f AS (SELECT file, count(*) FILTER (WHERE trim(line) <> '') AS n, arg_min(line, r) FILTER (WHERE trim(line) <> '') AS head FROM l GROUP BY file)
    SELECT file, 'HEADER' AS qid, CASE WHEN n = 0 THEN 'EMPTY_FILE' ELSE 'MISSING_STANDARD_HEADER' END AS code, CASE WHEN n = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity
    FROM f WHERE n = 0 OR NOT list_has_any(list_transform(string_split(lower(head), ','), lambda c: trim(replace(c, '"', ''))), ['qid', 'question_id'])"""
)
def file_issues(spark, sf_dir):
    """Three files: one without a heading, one of blank lines, one as it should be."""
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_partkey").alias("first"))
    files = {
        "nations": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_num"), F.concat("n_name", F.lit(",1")).alias("line")),
        "blank": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row_num"), F.expr("repeat(' ', cast(r_regionkey as int))").alias("line")),
        "parts": part.join(F.broadcast(first)).select(F.col("p_partkey").alias("row_num"), F.when(F.col("p_partkey") == F.col("first"), 'x, "Question_ID" ,answer').otherwise(F.col("p_name")).alias("line")),  # one row
    }
    found = [quality.file_issues(lines).select(F.lit(name).alias("file"), "qid", "code", "severity") for name, lines in files.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT lang AS doc_id, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM documents GROUP BY lang")
def sheet_text_lengths(spark, sf_dir):
    return reports.text_lengths(table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("text").alias("value")))


def text_query(name: str, of: str, key: str, made: str, expression: Callable, kind: str, result: str) -> None:
    """A text expression on texts ``made`` from a table's columns, on all documents and on all turns of conversations.

    ``result`` is SQL that works it out from the text, {t}, in its own way.
    """

    def run(spark, sf_dir):
        texts = table(spark, sf_dir, of).select(F.lit(of).alias("origin"), F.col(key).cast("string").alias("key"), F.expr(made).alias("t"))
        texts = texts.unionByName(table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("t")))
        texts = texts.unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("t")))
        return texts.select("origin", "key", expression(F.col("t")).cast(kind).alias("result"))

    QUERIES[name] = run
    SQL[name] = f"""WITH x AS (SELECT '{of}' AS origin, CAST({key} AS VARCHAR) AS key, {made} AS t FROM {of} UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'conversations', conv_id || ':' || turn, text FROM conversations)
    SELECT origin, key, CAST({result.replace("{t}", "t")} AS {kind.upper()}) AS result FROM x"""


_K, _N = "CAST(o_orderkey AS STRING)", "CAST(o_orderkey % 900 + 1 AS STRING)"


def _case(*texts: str, by: str = "o_orderkey") -> str:
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _number(x: str) -> str:
    """SQL for a number as a program writes it."""
    return rf"CASE WHEN regexp_full_match({_strip(x)}, '[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))') THEN TRY_CAST({_strip(x)} AS DOUBLE) END"


def _money(x: str) -> str:
    """SQL for an amount of money with currency, unit and closing mark."""
    bare = _strip(rf"regexp_replace({_strip(f"regexp_replace({_strip(x)}, '/-?$', '')")}, '(?i)^(?:INR|Rs\.?|₹)\s*', '')")
    shape = r"'(?i)^([0-9,]+(?:\.[0-9]+)?)\s*(crores?|cr|lakhs?|lacs?|thousand|k)?$'"
    unit = f"substr(lower(regexp_extract({bare}, {shape}, 2)), 1, 1)"
    factor = f"CASE {unit} WHEN 'c' THEN 10000000 WHEN 'l' THEN 100000 WHEN 't' THEN 1000 WHEN 'k' THEN 1000 ELSE 1 END"
    digits = f"replace(regexp_extract({bare}, {shape}, 1), ',', '')"
    return f"CASE WHEN regexp_matches({bare}, {shape}) THEN CAST(TRY_CAST({digits} AS DECIMAL(26,6)) * {factor} AS DOUBLE) ELSE {_number(f"replace({bare}, ',', '')")} END"


_MENTION = r"'(?i)(?:INR|Rs\.?|₹)\s*[0-9,]+(?:\.[0-9]+)?(?:\s*(?:crores?|cr|lakhs?|lacs?|thousand|k))?(?:\s*/-)?|[0-9,]+(?:\.[0-9]+)?\s*(?:crores?|cr|lakhs?|lacs?)\b'"
_TENS, _ONES = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"), ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_TEENS = ("zero", *_ONES, "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
_VALUE_OF = "CASE x.w " + " ".join(f"WHEN '{w}' THEN {n}" for n, w in [*enumerate(_TEENS), *((20 + 10 * i, w) for i, w in enumerate(_TENS))]) + r" ELSE CASE WHEN regexp_full_match(x.w, '[0-9,]*[0-9][0-9,]*(\.[0-9]+)?') THEN TRY_CAST(replace(x.w, ',', '') AS DOUBLE) END END"
_STATE = "{{'total': {0}::DOUBLE, 'part': {1}::DOUBLE, 'some': {2}, 'w': {3}}}"
_LARGE = "CASE WHEN starts_with(x.w, 'crore') OR x.w = 'cr' THEN 1e7 WHEN starts_with(x.w, 'lakh') OR starts_with(x.w, 'lac') THEN 1e5 END"
_FOLD = f"""list_reduce(list_prepend({_STATE.format("0", "0", "false", "''")}, list_transform(string_split_regex({_strip("replace(lower({t}), '-', ' ')")}, '\\s+'), lambda w: {_STATE.format("0", "0", "false", "w")})),
    lambda a, x: CASE WHEN ({_VALUE_OF}) IS NOT NULL THEN {_STATE.format("a.total", f"(a.part + ({_VALUE_OF}))", "true", "''")} WHEN x.w = 'hundred' THEN {_STATE.format("a.total", "(a.part * 100)", "a.some", "''")}
    WHEN ({_LARGE}) IS NOT NULL THEN {_STATE.format(f"(a.total + a.part * ({_LARGE}))", "0", "a.some", "''")} ELSE a END)"""
_CODE = r"regexp_extract({t}, '(?i)\b(?:Pkg|Package)[- ]?([A-Za-z0-9]+)\b', 1)"


def _has(words: str, x: str = "lower({t})") -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words.split("|")) + ")"


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_TERM = r"trim(nullif(regexp_extract({t}, '(?i)(?:excluding|remove|minus)\s+([A-Za-z0-9_\s]+?)(?:,|\s+what|\s+before|\s+so|\s*;|\s*—|\s*-|\s*\?|\s*:|\s*\.|\s*$)', 1), ''))"
_TERM = f"lower({_TERM})"
for _word in ("the", "a", "an"):
    _TERM = f"trim(regexp_replace({_TERM}, '^{_word} ', ''))"
for _word in ("segment", "division", "scope", "sector", "category", "works", "piece", "side"):
    _TERM = f"trim(regexp_replace({_TERM}, ' {_word}$', ''))"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{t}}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip("replace(s, chr(10), ' ')")}), lambda s: length(s) > 15)"
_CANON = _replaced("{t}", (r"(?i)\s*\((?:psu|government|private|govt)\)", ""))
_CANON = _replaced(_strip(_CANON), (r"(?i)\bCorp\b", "Corporation"), (r"(?i)\bDept\b", "Department"), (r"(?i)\bGovt\b", "Government"), (r"\s*,\s*", ", "), (r"\s+", " "))
# a word's bounds with all letters, which \\b of this engine does not know; twice, for what stands between two words is shared
_WORD = r"[\p{L}\p{N}_]"
_MENTIONED = _replaced("lower(coalesce({t}, ''))", *[step for a, b in (*names.ABBREVIATIONS.items(), *names.STATES.items()) for step in [(rf"(^|[^\p{{L}}\p{{N}}_]){a.replace('.', chr(92) + '.')}({_WORD if a.endswith('.') else r'$|[^\p{L}\p{N}_]'})", rf"\1{b}\2")] * 2])
_MENTIONED = _replaced(_MENTIONED, (r"[^\s\p{L}\p{N}_]", " "), (r"\s+", " "))

text_query("money_parse", "orders", "o_orderkey",
           _case(f"'INR ' || {_N} || ',00,000'", f"'Rs. ' || {_N} || '.13 Cr'", f"'₹ ' || {_N} || '.5 lakhs'", f"{_N} || ' Crores'", f"'Rs ' || {_N} || 'K'", f"'-' || {_N}", f"{_N} || ' thousand'", f"'about ' || {_N} || ' or so'", f"{_N} || '/-'"),
           money.parse_money, "double", _money("{t}"))
text_query("money_mentions", "orders", "o_orderkey", _case(f"'paid INR ' || {_N} || ' Cr and then Rs. 20,000/- of 3 lakh'", f"{_N} || ' workers, 2 Crores'", "'no money'"),
           lambda t: F.aggregate(money.money_mentions(t), F.lit(0.0), lambda a, m: a + m["value"].cast("double")), "double", f"coalesce(list_sum(list_transform(regexp_extract_all({{t}}, {_MENTION}), lambda m: {_money('m')})), 0)")
_WORDS = _case(*[f"'{w}'" for w in _TENS]) + " || '-' || " + _case(*[f"'{w}'" for w in _ONES])
text_query("num_words", "orders", "o_orderkey", f"'the sum of ' || {_WORDS} || {_case(chr(39) + ' lakh' + chr(39), chr(39) + ' crore and two hundred lakh' + chr(39), chr(39) + chr(39))}", money.number_in_words, "double", f"CASE WHEN ({_FOLD}).some THEN ({_FOLD}).total + ({_FOLD}).part END")
text_query("package_code", "orders", "o_orderkey", _case(f"'works of Pkg-' || {_K} || ' here'", f"'PACKAGE ' || {_K}", f"'pkg' || {_K}", "'none of these'"), names.package_code, "string", r"'Pkg-' || nullif(regexp_extract({t}, '(?i)(?:Pkg|Package)[- ]?([A-Za-z0-9-]+)', 1), '')")
text_query("normalized_package", "orders", "o_orderkey", _case(f"'AB-CD-' || {_K} || ' of Pkg-3'", f"'Pkg-' || {_K}", f"'Package ' || {_K}", "'Pkg-A'"), lambda t: names.normalized_package(t, F.lit(None).cast("string")), "string",
           rf"coalesce(nullif(regexp_extract({{t}}, '\b([A-Z]{{2}}-[A-Z]{{2}}-[0-9]+)\b', 1), ''), CASE WHEN {_CODE} <> '' AND NOT regexp_full_match({_CODE}, '[A-Za-z]') THEN 'Pkg-' || {_CODE} END)")
_VALID = _number("regexp_replace({t}, '[,₹%]|INR', '', 'g')")
text_query("number_validity", "orders", "o_orderkey", _case(f"' ' || {_N} || ',000.50 '", f"'INR ' || {_N}", f"{_N} || '.5%'", f"{_N} || ' Cr'", f"'₹' || {_N}", "'inf'"), A.valid_number, "double", f"CASE WHEN isfinite({_VALID}) THEN {_VALID} END")
text_query("shape_router", "orders", "o_orderkey", _case(f"'How many of ' || {_N} || ' works have no client reference?'", "'what is the mean size of works'", "'the largest and the second largest work'", "'total excluding roads'", f"'works above ' || {_N} || ' Cr'", f"'all works of ' || {_N}"),
           lambda t: baseline.infer_shape(t, F.lit("money")), "string",
           f"CASE WHEN {_has('no client reference|lack a client reference|no reference letter|without reference')} THEN 'absence' WHEN {_has('distinct|different categories|classifications')} THEN 'distinct_count' WHEN {_has('after that date|after her pmp|after his pmp|after certification')} THEN 'temporal_chain' "
           f"WHEN {_has('average size|mean size')} THEN 'avg_work_size' WHEN {_has('exclud')} AND {_has('excluding|exclude')} THEN 'exclusion_aggregate' WHEN {_has('additional work|reach our credential target|gap between')} THEN 'gap_to_threshold' WHEN {_has('second largest')} THEN 'rank_value' "
           f"WHEN {_has('share of completed|divided by the total|collection figure|collection percentage|collected against')} THEN 'referenced_share' WHEN {_has('crossing|hitting the|above|over')} THEN 'threshold_aggregate' ELSE 'hop_aggregate' END")  # fmt: skip
text_query("file_kind", "orders", "o_orderkey", _case(f"'DOC-CC-' || {_K} || '.pdf'", f"'DOC-REF-' || {_K} || '.pdf'", f"'bond_' || {_K} || '.pdf'", f"{_K} || '-personnel.pdf'", f"'my-cv-' || {_K} || '.pdf'", f"'RA-bill' || {_K} || '.pdf'", f"'ageing' || {_K} || '.xlsx'"),
           extract.kind_of_file, "string",
           f"CASE WHEN {_has('cc|completion')} THEN 'completion_certificate' WHEN {_has('ref|recommendation')} THEN 'reference_letter' WHEN {_has('bond|guarantee')} THEN 'performance_bond' WHEN {_has('pcert|personnel')} THEN 'personnel_certificate' WHEN {_has('cv')} THEN 'cv' WHEN {_has('bill|ra')} THEN 'ra_bill' WHEN ends_with(lower({{t}}), '.xlsx') THEN 'workbook' ELSE 'completion_certificate' END")
text_query("excluded_term", "orders", "o_orderkey", _case(f"'Total excluding the bridges' || {_K} || ' segment, please'", f"'remove a road' || {_K} || ' works - now'", f"'minus tunnels' || {_K}", "'nothing'"), primary.excluded_term, "string", _TERM)
text_query("grading_sentence", "orders", "o_orderkey", _case(f"'We did it. The work ' || {_K} || ' was graded Excellent by all. End.'", f"'Workmanship of ' || {_K} || ' was found satisfactory indeed. Bye.'", "'None here.'"),
           text.grading_sentence, "string",
           f"coalesce(list_filter({_SENTENCES}, lambda s: {_has('graded|quality of the completed work|overall quality', 'lower(s)')})[1], list_filter({_SENTENCES}, lambda s: contains(lower(s), 'workmanship') AND contains(lower(s), 'satisfactory'))[1])")
text_query("client_key", "customer", "c_custkey", "'Public Works Dept , Govt of X' || CAST(c_custkey AS STRING) || ' (PSU)'", names.client_key, "string",
           rf"CASE WHEN NOT {_has('national infrastructure corp|government of india / state authority|issued under the provisions')} THEN {_strip(rf"regexp_replace(replace(replace(lower(nullif({_strip(_CANON)}, '')), ',', ''), '&', 'and'), '\s+', ' ', 'g')")} END")
text_query("mention_normalize", "customer", "c_custkey", "'Irrig. Dept of Z' || CAST(c_custkey AS STRING) || '!'", names.normalize_mention, "string", _strip(_MENTIONED))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS result FROM orders")
def date_parse(spark, sf_dir):
    """Dates of orders in four writings, within a text."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    said = F.when(k == 0, F.concat(F.lit("on "), F.date_format(day, "MMMM d, yyyy"))).when(k == 1, F.date_format(day, "d MMM yyyy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(said).cast("string").alias("result"))


@query(
    """SELECT c_custkey, k, v FROM (SELECT c_custkey, 'client' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'value', 'INR ' || c_custkey || ' Cr' FROM customer
    UNION ALL SELECT c_custkey, 'date', '2021-01-02' FROM customer UNION ALL SELECT c_custkey, 'note', c_mktsegment FROM customer)"""
)
def kv_pairs(spark, sf_dir):
    """Labels in a table, bold, plain, and on lines of their own."""
    key = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("|Client|"), "c_name", F.lit("|\n**Value:** INR "), key, F.lit(" Cr\nDate: 2021-01-02\nnote\n"), "c_mktsegment")
    rows = text.with_key_values(table(spark, sf_dir, "customer").select("c_custkey", t.alias("text"))).select("c_custkey", F.explode("kv").alias("k", "v"))
    return rows.where(F.col("k").isin("client", "value", "date", "note"))
