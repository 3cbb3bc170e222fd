"""The operators on the driver's tables, each with the SQL that states the same.

Clients are customers, works are orders, values are total prices, categories are order priorities; a work has a letter
if it has line items, and what is invoiced and received comes from those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import basic, dates, money, names, text
from .operators import contain, entities, quality, resolve, works
from .plans import baseline, extract, primary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registering(queries: dict, sqls: dict):
    """A decorator that registers a query under its function's name, with the SQL that states the same."""

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql is not None:
                sqls[function.__name__] = sql
            return function

        return add

    return query


query = registering(QUERIES, SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with exact prices and dates without a time."""
    return table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("day", F.col("o_orderdate").cast("date"))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the form of certificates."""
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("client_name"), F.col("o_orderpriority").alias("package_code"),
        F.concat(F.lit("Work "), F.col("o_orderkey").cast("string")).alias("project_name"), F.col("o_orderpriority").alias("category"), F.col("price").alias("contract_value"),
        F.col("day").alias("completion_date"), F.lit(None).cast("string").alias("project_lead"),
        F.when(F.col("o_orderstatus") == "F", "completion_certificate").otherwise("company_completion_certificate").alias("doc_type"),
    )


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal_rows(columns: tuple[str, ...], rows: list[tuple]) -> str:
    """SQL for rows that are known beforehand."""

    def one(value) -> str:
        if value is None:
            return "NULL"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else repr(value)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
EXACT = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(f"SELECT o_custkey, CAST(sum({PRICE}) AS DOUBLE) AS total, count(*) AS works FROM orders GROUP BY o_custkey")
def hop_aggregate(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("price").cast("double").alias("total"), F.count("*").alias("works"))


@query(f"SELECT o_custkey, CAST(coalesce(sum({PRICE}) FILTER (WHERE {PRICE} >= 150000), 0) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def threshold_aggregate(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("price") >= 150000, F.col("price"))), F.lit(0)).cast("double").alias("total"))


@query(f"SELECT o_custkey, CAST(round(CAST(sum({PRICE}) AS DECIMAL(28,2)) / count(*)) AS BIGINT) AS mean FROM orders GROUP BY o_custkey")
def avg_work_size(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.round(F.sum("price") / F.count("*"), 0).cast("bigint").alias("mean"))


@query(f"SELECT o_custkey, CAST(greatest(0, 1000000 - sum({PRICE})) AS DOUBLE) AS gap FROM orders GROUP BY o_custkey")
def gap_to_threshold(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.greatest(F.lit(0), F.lit(1000000) - F.sum("price")).cast("double").alias("gap"))


@query(f"SELECT o_custkey, CAST(abs(coalesce(sum({PRICE}) FILTER (WHERE year(o_orderdate) = 1995), 0) - coalesce(sum({PRICE}) FILTER (WHERE year(o_orderdate) = 1996), 0)) AS DOUBLE) AS gap FROM orders GROUP BY o_custkey")
def year_over_year_gap(spark, sf_dir):
    of = lambda y: F.coalesce(F.sum(F.when(F.year("day") == y, F.col("price"))), F.lit(0))
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.abs(of(1995) - of(1996)).cast("double").alias("gap"))


@query("SELECT o_custkey, count(*) AS without FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) GROUP BY o_custkey")
def absence_count(spark, sf_dir):
    return orders(spark, sf_dir).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_custkey").agg(F.count("*").alias("without"))


@query("SELECT o_custkey, CAST(abs(date_diff('day', DATE '2021-03-10', max(CAST(o_orderdate AS DATE)))) AS BIGINT) AS days FROM orders GROUP BY o_custkey")
def date_span(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(dates.days_between(F.max("day"), F.to_date(F.lit(primary.ANCHOR))).alias("days"))


@query(f"SELECT o_custkey, CAST(max(v) FILTER (WHERE n = 1) - max(v) FILTER (WHERE n = 2) AS DOUBLE) AS gap FROM (SELECT o_custkey, {PRICE} AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY {PRICE} DESC, o_orderkey) AS n FROM orders) GROUP BY o_custkey HAVING count(*) >= 2")
def rank_value_gap(spark, sf_dir):
    return works.largest_gap(orders(spark, sf_dir), ["o_custkey"], "price").withColumn("gap", F.col("gap").cast("double"))


@query(f"SELECT o_custkey, avg(CAST({PRICE} AS DOUBLE)) - median(CAST({PRICE} AS DOUBLE)) AS gap FROM orders GROUP BY o_custkey")
def mean_median_gap(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg((F.avg(F.col("price").cast("double")) - F.median(F.col("price").cast("double"))).alias("gap"))


@query("SELECT o_custkey, 100.0::DOUBLE * count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) / count(*)::DOUBLE AS share FROM orders o GROUP BY o_custkey")
def referenced_share(spark, sf_dir):
    letters = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    rows = orders(spark, sf_dir).join(letters, F.col("o_orderkey") == F.col("k"), "left")
    return rows.groupBy("o_custkey").agg((F.lit(100.0) * F.count("k").cast("double") / F.count("*").cast("double")).alias("share"))


_BILLED = f"SELECT o_custkey, sum({EXACT}) AS invoiced, sum({EXACT} * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS received FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"


def billed(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("i"), (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).alias("r"))
    # sums for each order before the join: the join then has one row for each order
    lines = lines.groupBy("l_orderkey").agg(F.sum("i").alias("i"), F.sum("r").alias("r"))
    return lines.join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("i").alias("invoiced"), F.sum("r").alias("received"))


@query(f"SELECT o.o_custkey, CAST(abs(o.awarded - coalesce(b.invoiced, 0)) AS DOUBLE) AS gap FROM (SELECT o_custkey, sum({PRICE}) AS awarded FROM orders GROUP BY o_custkey) o LEFT JOIN ({_BILLED}) b ON o.o_custkey = b.o_custkey")
def billing_gap(spark, sf_dir):
    awarded = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("price").alias("awarded"))
    return awarded.join(billed(spark, sf_dir), "o_custkey", "left").select("o_custkey", F.abs(F.col("awarded") - F.coalesce("invoiced", F.lit(0))).cast("double").alias("gap"))


@query(f"SELECT o_custkey, 100 * CAST(received AS DOUBLE) / CAST(invoiced AS DOUBLE) AS pct FROM (SELECT o_custkey, sum({EXACT}) AS invoiced, sum({EXACT} * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS received FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) WHERE invoiced > 0")
def collection_pct(spark, sf_dir):
    rows = billed(spark, sf_dir).where("invoiced > 0")
    return rows.select("o_custkey", (100 * F.col("received").cast("double") / F.col("invoiced").cast("double")).alias("pct"))


@query(f"SELECT o_custkey, CAST(sum({PRICE}) AS DOUBLE) AS total FROM orders WHERE lower(o_orderpriority) NOT LIKE '%urgent%' GROUP BY o_custkey")
def exclusion_aggregate(spark, sf_dir):
    return orders(spark, sf_dir).where(~basic.has_any(F.lower("o_orderpriority"), ("urgent",))).groupBy("o_custkey").agg(F.sum("price").cast("double").alias("total"))


@query("SELECT l_suppkey, count(DISTINCT p_type) AS categories FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def distinct_categories(spark, sf_dir):
    led = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return led.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.count_distinct("p_type").alias("categories"))


@query(f"WITH f AS (SELECT l_suppkey AS s, min(l_shipdate) AS since FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) SELECT l_suppkey, CAST(sum({EXACT}) AS DOUBLE) AS total FROM lineitem JOIN f ON l_suppkey = s WHERE l_shipdate > since GROUP BY l_suppkey")
def temporal_chain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = lines.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s")).agg(F.min("l_shipdate").alias("since"))
    after = lines.join(first, F.col("l_suppkey") == F.col("s")).where(F.col("l_shipdate") > F.col("since"))
    return after.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"SELECT o_custkey, o_orderpriority, o_orderkey, CAST(v AS DOUBLE) AS value FROM (SELECT *, {PRICE} AS v, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY {PRICE} DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def portfolio_dedup_primary(spark, sf_dir):
    rows = works.portfolio_primary(certificates(spark, sf_dir))
    return rows.select(F.col("client_name").cast("bigint").alias("o_custkey"), F.col("package_code").alias("o_orderpriority"), F.col("doc_id").alias("o_orderkey"), F.col("contract_value").cast("double").alias("value"))


@query(
    f"""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC,
    CASE WHEN o_orderstatus = 'F' THEN {PRICE} END ASC NULLS FIRST, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END DESC NULLS LAST,
    CASE WHEN o_orderstatus <> 'F' THEN {PRICE} END DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def portfolio_dedup_baseline(spark, sf_dir):
    rows = works.portfolio_baseline(certificates(spark, sf_dir).withColumn("project_name", F.lit(None).cast("string")))
    return rows.select(F.col("client_name").cast("bigint").alias("o_custkey"), F.col("package_code").alias("o_orderpriority"), F.col("doc_id").alias("o_orderkey"))


@query("SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) < 1000)")
def band_semi_join(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return works.close_to_another(rows, ["o_custkey"], "o_totalprice", 1000).select("o_orderkey")


@query(
    f"""SELECT o_orderkey, (l IS NOT NULL) OR EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_custkey = w.o_custkey AND abs({PRICE.replace("o_total", "b.o_total")} - v) < 1000) AS referenced
    FROM (SELECT o_orderkey, o_custkey, {PRICE} AS v, CASE WHEN o_orderstatus = 'F' THEN 1 END AS l FROM orders) w"""
)
def referenced_works(spark, sf_dir):
    rows = certificates(spark, sf_dir).withColumn("package_code", F.col("project_name"))
    letters = rows.where("doc_type = 'completion_certificate'").select("package_code", F.col("client_name").alias("issuing_client"), "contract_value")
    return works.referenced(rows, letters).select(F.col("doc_id").alias("o_orderkey"), "referenced")


@query(
    """WITH b AS (SELECT o_custkey AS q, count(*)::DOUBLE AS base FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey AS q, count(*)::DOUBLE AS cand FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT CAST(coalesce(b.q, c.q) AS VARCHAR) AS qid, base, cand, CASE WHEN base IS NOT DISTINCT FROM cand THEN 'UNCHANGED' ELSE 'DIFFERENT' END AS status FROM b FULL JOIN c ON b.q = c.q"""
)
def answer_diff(spark, sf_dir):
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").cast("string").alias("qid")).agg(F.count("*").cast("double").alias("answer"))
    return quality.compare(of("F"), of("O")).select("qid", "base", "cand", "status")


# A scored set of answers: the total price is the gold value, the sum of the line items what was answered.
_SCORED = """SELECT o_orderkey AS qid, o_orderpriority AS shape, o_orderstatus AS answer_type, o_totalprice AS gold, got,
    CASE WHEN got IS NULL THEN 0.0::DOUBLE WHEN o_totalprice = 0 THEN CASE WHEN got = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, 1 - abs(got - o_totalprice) / abs(o_totalprice)) END AS score
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS got FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def scored_orders(spark, sf_dir) -> DataFrame:
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("got"))
    rows = table(spark, sf_dir, "orders").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("shape"), F.col("o_orderstatus").alias("answer_type"), F.col("o_totalprice").alias("gold"), "got", A.score_one(F.col("o_totalprice"), F.col("got")).alias("score"))


@query(f"SELECT qid, round(score, 6) AS score FROM ({_SCORED})")
def score_one(spark, sf_dir):
    return scored_orders(spark, sf_dir).select("qid", F.round("score", 6).alias("score"))


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT CASE WHEN score >= 1 THEN 'exact' WHEN score >= 0.95 THEN '95-99.9%' WHEN score >= 0.8 THEN '80-94.9%' WHEN score >= 0.5 THEN '50-79.9%' WHEN score > 0 THEN '>0-49.9%' ELSE 'zero' END AS bucket FROM s)
    SELECT place, b.bucket, (SELECT count(*) FROM c WHERE c.bucket = b.bucket) AS "count" FROM (VALUES (0, 'exact'), (1, '95-99.9%'), (2, '80-94.9%'), (3, '50-79.9%'), (4, '>0-49.9%'), (5, 'zero')) AS b(place, bucket)"""
)
def error_histogram(spark, sf_dir):
    return quality.histogram(scored_orders(spark, sf_dir))


@query(
    f"""WITH s AS ({_SCORED}) SELECT CASE WHEN grouping(shape) = 0 THEN 'shape' WHEN grouping(answer_type) = 0 THEN 'answer_type' ELSE 'all' END AS dimension, coalesce(shape, answer_type) AS value,
    round(sum(score), 6) AS score, count(*) AS questions, round(100 * sum(score) / count(*), 6) AS percentage FROM s GROUP BY GROUPING SETS ((shape), (answer_type), ())"""
)
def score_grouping_sets(spark, sf_dir):
    rows = quality.breakdown(scored_orders(spark, sf_dir), ("shape", "answer_type"))
    return rows.select("dimension", "value", F.round("score", 6).alias("score"), "questions", F.round("percentage", 6).alias("percentage"))


@query(f"WITH s AS ({_SCORED}) SELECT qid, round(s.score, 9) AS score FROM s WHERE s.score < 1 ORDER BY s.score, qid LIMIT 10")
def top_k_misses(spark, sf_dir):
    return quality.extremes(scored_orders(spark, sf_dir))[0].select("qid", F.round("score", 9).alias("score"))


@query(f"SELECT CAST(sum(d) AS DOUBLE) AS total, CAST(sum(d) AS DOUBLE) / count(*) AS mean, count(*) AS questions FROM (SELECT round(score, 6)::DECIMAL(18,6) AS d FROM ({_SCORED}))")
def score_total(spark, sf_dir):
    rows = scored_orders(spark, sf_dir).select(F.round("score", 6).cast("decimal(18,6)").alias("s"))
    return rows.agg(F.sum("s").cast("double").alias("total"), (F.sum("s").cast("double") / F.count("*")).alias("mean"), F.count("*").alias("questions"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_quantity, count(*) AS frequency FROM lineitem GROUP BY l_quantity ORDER BY frequency DESC, l_quantity LIMIT 1")
def mode_frequency(spark, sf_dir):
    return quality.mode_with_count(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT o_orderpriority, o_totalprice AS upper_median, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER w AS r, count(*) OVER p AS n, min(o_totalprice) OVER p AS low, max(o_totalprice) OVER p AS high FROM orders WINDOW p AS (PARTITION BY o_orderpriority), w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)) WHERE r = n // 2 + 1")
def upper_median(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    ends = rows.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return quality.upper_median(rows, "o_orderpriority", "o_totalprice").join(ends, "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 ORDER BY o_orderstatus LIMIT 10")
def stratified_head(spark, sf_dir):
    return quality.first_of_each(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 10).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_ops(spark, sf_dir):
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).subtract(of("P"))


@query("SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier")
def engineer_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT a.id AS first_id, b.id AS second_id, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2")
def ambiguous_pairs(spark, sf_dir):
    return entities.ambiguous_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT qid, entity FROM (SELECT p_partkey AS qid, entity, row_number() OVER (PARTITION BY p_partkey ORDER BY length(entity) DESC, entity) AS n FROM part JOIN (SELECT DISTINCT lower(p_type) AS entity FROM part UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]) FROM part) ON contains(lower(p_name), entity) OR contains(lower(p_type), entity)) WHERE n = 1")
def longest_contained_entity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.select(F.lower("p_type").alias("entity")).union(part.select(F.lower(F.split("p_name", " ")[0]))).distinct()
    # a line end keeps an entity from reaching from one text into the other
    texts = part.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws("\n", "p_name", "p_type")).alias("text"))
    hits = contain.contained_pairs(texts, known.select(F.col("entity").alias("name")))
    return works.top_row(hits, ["id"], [F.length("name").desc(), F.col("name")]).select(F.col("id").alias("qid"), F.col("name").alias("entity"))


@query("SELECT user_id AS qid, event_id AS row_num, value AS answer, n > 1 AS duplicated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1")
def last_write_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("row_num"), F.col("value").alias("answer"))
    return works.last_write_wins(rows)


@query("SELECT conv_id, max(CASE WHEN n = 2 THEN line END) AS next_line, max(CASE WHEN n = 1 THEN line END) AS previous_line FROM (SELECT conv_id, turn AS n, 'c' || conv_id || ' turn ' || turn AS line FROM (SELECT DISTINCT conv_id FROM conversations) CROSS JOIN (VALUES (1), (2)) AS t(turn)) GROUP BY conv_id")
def next_line(spark, sf_dir):
    """The lines around a label and around a phrase, in texts of three lines with white space and empty lines between."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    line = lambda n: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(f" turn {n}"))
    rows = ids.select("conv_id", F.concat(line(1), F.lit("\n\n  Issued  \n "), line(2), F.lit("\nend")).alias("t"))
    return rows.select("conv_id", text.line_after(F.col("t"), "issued").alias("next_line"), text.line_before(F.col("t"), "ISSUED").alias("previous_line"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM documents")
def normalize_text(spark, sf_dir):
    clean = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "), " +", " ")
    return table(spark, sf_dir, "documents").select("doc_id", basic.strip(clean).alias("clean"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", basic.found(F.col("html"), "<title>([^<]*)</title>").alias("title"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3))::BIGINT AS words, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3)))::BIGINT AS distinct_words FROM documents")
def content_words(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("words"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct_words"))


@query("SELECT doc_id, len(l)::BIGINT AS n_lines, l[1] AS first_line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)")
def stripped_lines(spark, sf_dir):
    rows = basic.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(rows).cast("bigint").alias("n_lines"), F.try_element_at(rows, F.lit(1)).alias("first_line"))


@query("SELECT lang, count(*) AS documents, count(l.doc_id) AS labelled, 100.0::DOUBLE * count(l.doc_id) / count(*)::DOUBLE AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def anti_coverage(spark, sf_dir):
    index = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"))
    got = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("fields", F.create_map(F.lit("label"), F.lit("x")))
    rows = quality.coverage(index, got)
    return rows.select(F.col("doc_type").alias("lang"), F.col("total").alias("documents"), F.col("with_data").alias("labelled"), (F.lit(100.0) * F.col("with_data").cast("double") / F.col("total").cast("double")).alias("pct"))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def missing_ids(spark, sf_dir):
    q, a = (table(spark, sf_dir, t).select(F.col("doc_id").alias("qid")) for t in ("documents", "labels"))
    return quality.set_issues(q, a).where("code = 'MISSING_QUESTION_ID'").select(F.col("qid").alias("doc_id"))


_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'money' WHEN 1 THEN 'percent' WHEN 2 THEN 'count' ELSE 'days' END"
_VALUE = "(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * o_totalprice / (CASE WHEN o_orderkey % 5 = 0 THEN 400000 ELSE 10 END)"


def typed_answers(spark, sf_dir) -> DataFrame:
    """Order values as answers of the four types, with every kind of fault."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "money").when(k % 4 == 1, "percent").when(k % 4 == 2, "count").otherwise("days")
    value = F.when(k % 3 == 0, -1).otherwise(1) * F.col("o_totalprice") / F.when(k % 5 == 0, 400000).otherwise(10)
    return table(spark, sf_dir, "orders").select(k.alias("qid"), kind.alias("answer_type"), value.alias("v"))


@query(
    f"""WITH t AS (SELECT o_orderkey AS qid, {_KIND} AS k, {_VALUE} AS v FROM orders)
    SELECT qid, 'OUT_OF_BOUNDS_PERCENT' AS code FROM t WHERE k = 'percent' AND (v < 0 OR v > 100) UNION ALL SELECT qid, 'FRACTION_PERCENT_SUSPECTED' FROM t WHERE k = 'percent' AND v > 0 AND v <= 1
    UNION ALL SELECT qid, 'NEGATIVE_DAYS' FROM t WHERE k = 'days' AND v < 0 UNION ALL SELECT qid, 'SUSPICIOUS_DAYS' FROM t WHERE k = 'days' AND v > 18250
    UNION ALL SELECT qid, 'NEGATIVE_COUNT' FROM t WHERE k = 'count' AND v < 0 UNION ALL SELECT qid, 'NON_INTEGER_COUNT' FROM t WHERE k = 'count' AND v <> floor(v)
    UNION ALL SELECT qid, 'NEGATIVE_MONEY' FROM t WHERE k = 'money' AND v < 0 UNION ALL SELECT qid, 'SUSPICIOUS_HIGH_MONEY' FROM t WHERE k = 'money' AND v > {2 * A.COMPANY_TOTAL}"""
)
def answer_issues(spark, sf_dir):
    return typed_answers(spark, sf_dir).select("qid", F.explode(A.issues(F.col("v"), F.col("answer_type"))).alias("code"))


# the value at eight places, then rounded half away from zero at two, in decimals as the operator does
_CENTS = "CAST(round(CAST({0} AS DECIMAL(28,8)), 2) AS DOUBLE)"


@query(
    f"""WITH t AS (SELECT o_orderkey AS qid, {_KIND} AS k, {_VALUE} AS v FROM orders)
    SELECT qid, CASE k WHEN 'percent' THEN {_CENTS.format("least(greatest(CASE WHEN v > 0 AND v <= 1 THEN v * 100 ELSE v END, 0), 100)")} WHEN 'money' THEN {_CENTS.format("greatest(v, 0)")} ELSE greatest(round_even(v, 0), 0) + 0.0::DOUBLE END AS answer FROM t"""
)
def repair(spark, sf_dir):
    return typed_answers(spark, sf_dir).select("qid", A.repaired(F.col("v"), F.col("answer_type")).alias("answer"))


@query(f"WITH t AS (SELECT {_KIND} AS k, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE floor({_VALUE}) END AS v FROM orders WHERE o_orderkey % 11 <> 0) SELECT k AS answer_type, count(*) AS total, count(*) FILTER (WHERE v <> -1) AS valid, count(*) FILTER (WHERE v = 0) AS zeros, CAST(sum(v) FILTER (WHERE v <> -1) AS DOUBLE) AS sum FROM t GROUP BY k")
def type_statistics(spark, sf_dir):
    """Whole numbers as answers; -1 is handed in as a word, and every eleventh question has no answer."""
    rows = typed_answers(spark, sf_dir).withColumn("v", F.when(F.col("qid") % 7 == 0, 0).otherwise(F.floor("v")))
    text = F.when(F.col("v") == -1, F.lit("none")).otherwise(F.col("v").cast("bigint").cast("string"))
    answers = rows.where("qid % 11 <> 0").select("qid", text.alias("raw_answer"), F.lit(1).alias("row_num"))
    return quality.type_statistics(rows.select("qid", "answer_type"), answers)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def category_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, bool_or(o_orderstatus = 'P') AS has_pending, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey")
def collected_sets(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_pending"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))


@query("SELECT format('CLIENT-{:03d}', row_number() OVER (ORDER BY c_name)) AS client_id, c_name AS key FROM customer")
def numbered_clients(spark, sf_dir):
    return entities.numbered(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")), "key", "CLIENT-%03d", "client_id")


@query("SELECT p_partkey, CASE WHEN contains(n, 'bridge') THEN 'bridges flyovers' WHEN contains(n, 'building') OR contains(n, 'quarters') OR contains(n, 'block') THEN 'buildings' WHEN contains(n, 'wtp') OR contains(n, 'water') THEN 'water treatment' WHEN contains(n, 'stp') OR contains(n, 'drainage') OR contains(n, 'sewerage') THEN 'sewerage drainage' WHEN contains(n, 'road') OR contains(n, 'highway') THEN 'roads maintenance' WHEN contains(n, 'tunnel') THEN 'tunnels' WHEN contains(n, 'substation') OR contains(n, 'power') THEN 'power infra' END AS category FROM (SELECT p_partkey, lower(p_name) AS n FROM part)")
def category_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.category_of_name(F.col("p_name")).alias("category"))


@query()
def fuzzy_resolve(spark, sf_dir):
    """Parts by type and name, in mentions that each layer has a share of.

    A type and name in full is found by containment, one in another order or cut short by words in common and
    token-set similarity; a name alone fits a part of every type and is left to the last resort. Every tenth mention names no part.
    """
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    full, turned = F.concat_ws(" ", "p_type", "p_name"), F.concat_ws(" ", "p_name", "p_type")
    short = F.concat_ws(" ", "p_name", F.expr("left(p_type, length(p_type) - 2)"))
    text = F.when(key % 10 == 9, F.col("p_brand")).when(key % 4 == 0, F.concat(F.lit("one "), full, F.lit(" in stock"))).when(key % 4 == 1, turned).when(key % 4 == 2, short).otherwise(F.col("p_name"))
    return resolve.resolve(part.select(key.cast("string").alias("qid"), text.alias("text")), part.select(full.alias("entity")).distinct())


def _inline_questions(spark) -> DataFrame:
    rows = [
        ("q1", "What is the total value of all completed assignments?", "money", "1"), ("q2", "Total excluding urgent works, please", "money", "1"), ("q3", "How many have no client reference?", "count", "2"),
        ("q4", "What is the average size of its works?", "money", "4"), ("q5", "How much does the largest work exceed the second largest?", "money", "1"), ("q6", "What share carry formal verification?", "percent", "1"),
        ("q7", "Difference between the mean and the median?", "money", "4"), ("q8", "anything", "money", None), ("q9", "anything", "count", None),
    ]
    return spark.createDataFrame(rows, "qid string, question string, answer_type string, client string").withColumns({"engineer": F.lit(None).cast("string"), "package": F.lit(None).cast("string")})


_W = f"(SELECT *, {PRICE} AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY {PRICE} DESC, o_orderkey) AS n FROM orders) WHERE n = 1)"


@query(
    f"""WITH w AS {_W}, l AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 495000), f AS (SELECT w.*, (o_orderpriority IN (SELECT p FROM l)) OR EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'P' AND b.o_totalprice > 495000 AND b.o_custkey = w.o_custkey AND abs({PRICE.replace("o_total", "b.o_total")} - w.v) < 1000) AS r FROM w)
    SELECT 'q1' AS qid, 'hop_aggregate' AS shape, round_even(CAST(coalesce(sum(v), 0) AS DOUBLE), 0) AS answer FROM w WHERE o_custkey = 1
    UNION ALL SELECT 'q2', 'exclusion_aggregate', round_even(CAST(coalesce(sum(v) FILTER (WHERE NOT contains(lower(o_orderpriority), 'urgent')), 0) AS DOUBLE), 0) FROM w WHERE o_custkey = 1
    UNION ALL SELECT 'q3', 'absence', CAST(count(*) FILTER (WHERE NOT r) AS DOUBLE) FROM f WHERE o_custkey = 2
    UNION ALL SELECT 'q4', CASE WHEN count(*) > 0 THEN 'avg_work_size' ELSE 'fallback' END, coalesce(round_even(avg(CAST(v AS DOUBLE)), 0), 1e8) FROM w WHERE o_custkey = 4
    UNION ALL SELECT 'q5', CASE WHEN count(*) > 1 THEN 'rank_value_gap' ELSE 'fallback' END, CASE WHEN count(*) > 1 THEN round_even(CAST(list_sort(list(v), 'DESC')[1] - list_sort(list(v), 'DESC')[2] AS DOUBLE), 0) ELSE 1e8 END FROM w WHERE o_custkey = 1
    UNION ALL SELECT 'q6', CASE WHEN count(*) > 0 THEN 'referenced_share' ELSE 'fallback' END, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE r) / count(*), 2) ELSE 50 END FROM f WHERE o_custkey = 1
    UNION ALL SELECT 'q7', CASE WHEN count(*) > 0 THEN 'mean_median_gap' ELSE 'fallback' END, coalesce(round_even(avg(CAST(v AS DOUBLE)) - median(CAST(v AS DOUBLE)), 0), 1e8) FROM w WHERE o_custkey = 4
    UNION ALL SELECT 'q8', 'fallback', 1e8 UNION ALL SELECT 'q9', 'fallback', 1.0"""
)
def primary_solver(spark, sf_dir):
    certs = certificates(spark, sf_dir)
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 495000").select("o_orderkey")
    letters = certs.join(pending, F.col("doc_id") == F.col("o_orderkey"), "left_semi").select("package_code", F.col("client_name").alias("issuing_client"), "contract_value")
    none = spark.createDataFrame([], "client_name string, invoiced decimal(18,2), received decimal(18,2)")
    people = spark.createDataFrame([], "doc_id long, engineer_name string, issue_date date")
    return primary.solve(_inline_questions(spark), certs, letters, none, people)


@query(
    f"""WITH w AS (SELECT o_custkey, v FROM (SELECT *, {PRICE} AS v, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC,
        CASE WHEN o_orderstatus = 'F' THEN {PRICE} END ASC NULLS FIRST, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END DESC NULLS LAST, CASE WHEN o_orderstatus <> 'F' THEN {PRICE} END DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1),
    a AS (SELECT c_custkey AS k, count(v) AS works, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(v) AS DOUBLE) / count(v) AS mean, CAST(coalesce(sum(v) FILTER (WHERE v >= 100000), 0) AS DOUBLE) AS above, list_sort(list(v), 'DESC') AS vs FROM customer LEFT JOIN w ON c_custkey = o_custkey GROUP BY c_custkey)
    SELECT k || '-0' AS qid, 'hop_aggregate' AS shape, CASE WHEN works > 0 THEN total ELSE 5e8 END AS answer FROM a
    UNION ALL SELECT k || '-1', 'avg_work_size', CASE WHEN works > 0 THEN round_even(mean, 0) ELSE 2e8 END FROM a
    UNION ALL SELECT k || '-2', 'rank_value', CASE WHEN works > 1 THEN CAST(vs[1] - vs[2] AS DOUBLE) WHEN works = 1 THEN CAST(vs[1] AS DOUBLE) ELSE 5e7 END FROM a
    UNION ALL SELECT k || '-3', 'threshold_aggregate', CASE WHEN works > 0 THEN above ELSE 5e8 END FROM a"""
)
def baseline_solver(spark, sf_dir):
    """Four questions about every customer, by the customers' names in their texts."""
    names_of = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name")
    certs = certificates(spark, sf_dir).join(names_of, F.col("client_name") == F.col("k")).withColumn("client_name", F.col("c_name")).withColumn("project_name", F.lit(None).cast("string"))
    letters = certs.where("doc_type = 'completion_certificate'").select(F.col("client_name").alias("issuing_client"), F.col("package_code").alias("project_name"))
    texts = ("Total value delivered for {}?", "What is the mean size of the works of {}?", "By how much is the largest above the second largest of {}?", "All works of {} over 1 lakh?")
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(texts)]))
    asked = names_of.select("k", "c_name", kinds.alias("x")).select(F.concat_ws("-", "k", F.col("x.i").cast("string")).alias("qid"), F.replace(F.col("x.t"), F.lit("{}"), F.col("c_name")).alias("question"), F.lit("money").alias("answer_type"))
    people = spark.createDataFrame([], "doc_id long, engineer_name string, issue_date date")
    return baseline.solve(asked, certs, letters, people)


# A text of each kind of record, from an order; both engines read the records out of the same text.
_K, _P, _D = "CAST(o_orderkey AS STRING)", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS STRING)"
RECORDS = (
    ("completion_certificate", f"'Roads Authority ' || {_K} || chr(10) || 'This is to certify that the work of \"Bridge Pkg-' || {_K} || '\", awarded to us for INR ' || {_P} || ', was completed on ' || {_D} || '. It was supervised by Asha Rao. The work was graded Good by all.'"),
    ("reference_letter", f"'Ref: ' || {_K} || chr(10) || 'Water Board ' || {_K} || chr(10) || 'Subject: \"WTP Pkg-' || {_K} || '\"' || chr(10) || 'Value: Rs. ' || {_P} || chr(10) || 'completed on ' || {_D}"),
    ("performance_bond", f"'**Guarantee amount:** INR ' || {_P} || chr(10) || 'ABC Bank ' || {_K} || chr(10) || 'work of \"Dam Pkg-' || {_K} || '\".' || chr(10) || 'until **' || {_D} || '**'"),
    ("personnel_certificate", f"'Employee Name: B Iyer ' || {_K} || chr(10) || 'Employee ID: EMP-' || {_K} || chr(10) || 'PMP' || chr(10) || 'Issued: ' || {_D}"),
    ("cv", f"'Name: C Das ' || {_K} || chr(10) || 'Designation: Lead' || chr(10) || '|1|Road ' || {_K} || '|Pkg-' || {_K} || '|PWD|Lead|'"),
    ("ra_bill", f"'Contract #' || {_K} || ' · Port ' || {_K} || chr(10) || 'Bill No: ' || {_K} || chr(10) || '|1|Earth|m3|10|5|50|' || chr(10) || 'Rs. ' || {_P}"),
)
_TEXTS = " ".join(f"WHEN {i} THEN {made}" for i, (_, made) in enumerate(RECORDS))
_KINDS = " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(RECORDS))


@query(
    rf"""WITH d AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 {_KINDS} END AS kind, CASE o_orderkey % 6 {_TEXTS} END AS t FROM orders)
    SELECT doc_id, kind, CASE kind WHEN 'cv' THEN regexp_extract(t, '\|1\|([^|]+)', 1) WHEN 'reference_letter' THEN regexp_extract(t, 'Subject: "([^"]+)', 1) ELSE nullif(regexp_extract(t, 'work of "([^"]+)', 1), '') END AS project,
    nullif(regexp_extract(t, 'Pkg-[0-9]+'), '') AS package,
    CASE kind WHEN 'completion_certificate' THEN regexp_extract(t, '^[^\n]+') WHEN 'reference_letter' THEN regexp_extract(t, 'Water [^\n]+') WHEN 'performance_bond' THEN regexp_extract(t, 'ABC [^\n]+') WHEN 'ra_bill' THEN regexp_extract(t, 'Port [^\n]+') ELSE regexp_extract(t, 'Name: ([^\n]+)', 1) END AS party,
    CASE WHEN kind NOT IN ('personnel_certificate', 'cv') THEN CAST(regexp_extract(t, '(?:INR|Rs\.) ([0-9.]+[0-9])', 1) AS DOUBLE) END AS value, CASE WHEN kind NOT IN ('cv', 'ra_bill') THEN nullif(regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') END AS day,
    CASE kind WHEN 'completion_certificate' THEN regexp_extract(t, 'The work was graded .*$') WHEN 'personnel_certificate' THEN regexp_extract(t, 'EMP-[0-9]+') WHEN 'cv' THEN regexp_extract(t, 'Designation: ([^\n]+)', 1) WHEN 'ra_bill' THEN regexp_extract(t, 'Bill No: ([0-9]+)', 1) || ' Earth 50.0' END AS more FROM d"""
)
def extract_records(spark, sf_dir):
    """Typed records of all six kinds of documents from their texts."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(f"CASE o_orderkey % 6 {_KINDS} END").alias("doc_type"), F.expr(f"CASE o_orderkey % 6 {_TEXTS} END").alias("text"))
    col, null = F.col, F.lit(None)

    def shaped(kind: str, rows: DataFrame, project, package, party, value, day, more) -> DataFrame:
        texts = [c.cast("string").alias(n) for n, c in (("project", project), ("package", package), ("party", party))]
        return rows.select("doc_id", F.lit(kind).alias("kind"), *texts, value.cast("double").alias("value"), day.cast("string").alias("day"), more.cast("string").alias("more"))

    name, code = col("project_name"), col("package_code")
    led, item = col("projects_led")[0], col("boq_items")[0]
    return (
        shaped("completion_certificate", extract.certificates(docs), name, code, col("client_name"), col("contract_value"), col("completion_date"), col("grading_text"))
        .unionByName(shaped("reference_letter", extract.reference_letters(docs), name, code, col("issuing_client"), col("contract_value"), col("completion_date"), null))
        .unionByName(shaped("performance_bond", extract.performance_bonds(docs), name, code, col("issuing_bank"), col("guarantee_amount"), col("expiry_date"), null))
        .unionByName(shaped("personnel_certificate", extract.personnel_certificates(docs), null, null, col("engineer_name"), null, col("issue_date"), col("employee_id")))
        .unionByName(shaped("cv", extract.cvs(docs), led["project_name"], led["package_code"], col("engineer_name"), null, null, col("designation")))
        .unionByName(shaped("ra_bill", extract.bills(docs), null, null, col("client_name"), col("billed_value"), null, F.concat_ws(" ", "bill_number", item["description"], item["amount"].cast("string"))))
    )
