"""Lookups in the tables of works, letters and personnel, for any number of names at once.

A name is a pattern as in LIKE, found anywhere and in any case: ``%`` stands for any text and ``_`` for one character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contain import contained_pairs
from .works import portfolio_baseline, top_row


def like_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """qid, name: which names (name) the patterns of the queries (qid, pattern) match.

    Names are looked up by the longest stretch of a pattern without wildcards, and then held against the whole. A null
    pattern, and one of wildcards alone, matches nothing. Repeated rows count once.
    """
    low = F.lower("pattern")
    stretches = F.filter(F.split(low, "[%_]"), lambda s: s != "")
    longest = F.array_max(F.transform(stretches, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    asked = queries.select("qid", "pattern", longest.alias("stretch")).where("stretch is not null").distinct()
    known = names.select("name", F.lower("name").alias("low")).where("name is not null").distinct()
    pairs = contained_pairs(known.select(F.col("low").alias("id"), F.col("low").alias("text")).distinct(), asked.select(F.col("stretch").alias("name")))
    hits = pairs.select(F.col("id").alias("low"), F.col("name").alias("stretch")).join(asked, "stretch").join(known, "low")
    whole = F.concat(F.lit("%"), F.replace(F.lower("pattern"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return hits.where(F.like("low", whole)).select("qid", "name").distinct()


def all_clients(certs: DataFrame) -> DataFrame:
    """client: the distinct names of clients."""
    return certs.where("client_name is not null and client_name <> ''").select(F.col("client_name").alias("client")).distinct()


def client_projects(queries: DataFrame, certs: DataFrame) -> DataFrame:
    """The works of all clients that a query (qid, pattern) matches, one for each name or package, a client's own certificate first: qid and the columns of certs."""
    pairs = like_pairs(queries, certs.select(F.col("client_name").alias("name"))).withColumnRenamed("name", "client_name")
    return portfolio_baseline(pairs.join(certs, "client_name"), "qid")


def engineer_projects(queries: DataFrame, certs: DataFrame) -> DataFrame:
    """The works led by whom a query matches, the earliest of each name: qid and the columns of certs."""
    pairs = like_pairs(queries, certs.select(F.col("project_lead").alias("name"))).withColumnRenamed("name", "project_lead")
    named = pairs.join(certs, "project_lead").where("nullif(trim(project_name), '') is not null")
    return top_row(named, ["qid", F.lower(F.trim("project_name"))], [F.col("completion_date").asc_nulls_first(), F.col("doc_id")])


def engineer_certifications(queries: DataFrame, personnel: DataFrame) -> DataFrame:
    """The certificates of whom a query matches: qid, nth (by issue date, one without a date first) and the columns of personnel.

    Where the query has a ``kind``, that pattern must match the certification's type.
    """
    queries = queries if "kind" in queries.columns else queries.withColumn("kind", F.lit(None).cast("string"))
    pairs = like_pairs(queries, personnel.select(F.col("engineer_name").alias("name"))).withColumnRenamed("name", "engineer_name")
    rows = pairs.join(personnel, "engineer_name").join(queries.select("qid", "kind").distinct(), "qid")
    rows = rows.where(F.col("kind").isNull() | F.like(F.lower("certification_type"), F.concat(F.lit("%"), F.lower("kind"), F.lit("%")))).drop("kind")
    first = F.expr("row_number() over (partition by qid order by issue_date asc nulls first, doc_id)")
    return rows.withColumn("nth", first)


def letter_counts(queries: DataFrame, letters: DataFrame) -> DataFrame:
    """qid, letters: how many differently named projects have a letter of a client that the query matches; 0 where none has."""
    pairs = like_pairs(queries, letters.select(F.col("issuing_client").alias("name"))).withColumnRenamed("name", "issuing_client")
    counts = pairs.join(letters, "issuing_client").groupBy("qid").agg(F.count_distinct("project_name").alias("letters"))
    return queries.select("qid").distinct().join(counts, "qid", "left").select("qid", F.coalesce("letters", F.lit(0)).alias("letters"))
