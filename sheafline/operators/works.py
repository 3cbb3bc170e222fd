"""Portfolios of works: which certificate stands for a work, and what is first or largest of a group.

Wherever rows tie, the smaller doc_id wins, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_row(rows: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def portfolio_primary(certs: DataFrame, client: str = "client_name") -> DataFrame:
    """A client's works: for each package the certificate of the largest value; without a package, one for each value.

    Columns: those of certs (doc_id, client, package_code, contract_value and more). Null values come last.
    """
    key = F.coalesce(F.nullif(F.col("package_code"), F.lit("")), F.concat(F.lit("VAL-"), F.coalesce(F.col("contract_value").cast("string"), F.lit("None"))))
    return top_row(certs, [F.lower(client), key], [F.col("contract_value").desc_nulls_last(), F.col("doc_id")])


def portfolio_baseline(certs: DataFrame, client: str = "client_name") -> DataFrame:
    """A client's works by name (or package, where there is no name): a client's own certificate beats the company's copy.

    Of the ``completion_certificate`` rows of a work the one with the lowest value stands; of others, where there
    is none of those, the one with the highest. Rows with neither name nor package are left out.
    """
    name, package = (F.nullif(F.trim(F.lower(c)), F.lit("")) for c in ("project_name", "package_code"))
    own = F.col("doc_type") == "completion_certificate"
    value = F.col("contract_value")
    order = [
        own.desc(),
        F.when(own, value).asc_nulls_first(),
        F.when(own, F.col("doc_id")).desc_nulls_last(),
        F.when(~own, value).desc_nulls_last(),
        F.col("doc_id"),
    ]
    keyed = certs.withColumn("_work", F.coalesce(name, package)).where("_work is not null")
    return top_row(keyed, [F.lower(client), "_work"], order).drop("_work")


def engineer_works(certs: DataFrame) -> DataFrame:
    """An engineer's works: the earliest completion of each name, a missing date counting as earliest."""
    named = certs.where("nullif(trim(project_name), '') is not null")
    return top_row(named, [F.lower("project_lead"), F.lower("project_name")], [F.col("completion_date").asc_nulls_first(), F.col("doc_id")])


def package_maxima(certs: DataFrame, keys: list[Column | str]) -> DataFrame:
    """The most valuable completed certificate of each package; certificates without a package are one group."""
    known = certs.where("contract_value is not null and completion_date is not null")
    return top_row(known, [*keys, "package_code"], [F.col("contract_value").desc(), F.col("doc_id")])


def first_certification(personnel: DataFrame) -> DataFrame:
    """Each engineer's certification with the earliest issue date; one without a date counts as earliest."""
    return top_row(personnel.where("engineer_name is not null"), [F.lower("engineer_name")], [F.col("issue_date").asc_nulls_first(), F.col("doc_id")])


def last_write_wins(answers: DataFrame) -> DataFrame:
    """The last row of each qid by row_num, and whether the qid occurs more than once."""
    counted = answers.withColumn("duplicated", F.count("*").over(Window.partitionBy("qid")) > 1)
    return top_row(counted, ["qid"], [F.col("row_num").desc()])


def largest_gap(rows: DataFrame, keys: list[str], value: str = "contract_value", name: str = "gap") -> DataFrame:
    """For each group with two values or more, the largest less the second largest. At most two rows of a group are shuffled by each task."""
    two = rows.where(F.col(value).isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc()))).where("_nth <= 2")
    return two.groupBy(*keys).agg((F.max(value) - F.min(value)).alias(name), F.count("*").alias("_n")).where("_n = 2").drop("_n")


def _band(value: Column, tolerance) -> Column:
    """The number of the band of width ``tolerance`` that an exact value lies in."""
    exact, width = value.cast("decimal(20,2)"), F.lit(tolerance).cast("decimal(20,2)")
    return ((exact - F.pmod(exact, width)) / width).cast("bigint")


def bands(rows: DataFrame, keys: list[Column], value: str, tolerance: float) -> DataFrame:
    """What each band of values, and its two neighbours, know of ``rows``: _k0, _k1, ..., _band, _n, _least, _most, _below, _above.

    _n, _least and _most are the rows of the band itself, its smallest and its largest value; _below is the largest value of the
    band before, _above the smallest of the band after. Two values of one band are always closer than the tolerance, and others are
    only if they are nearest across an edge: so one row for each band says whether a value has a close one,
    whatever number of rows a key has. Nulls lie in no band.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    exact = rows.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("decimal(20,2)").alias("_v"), _band(F.col(value), tolerance).alias("_b"))
    names = [f"_k{i}" for i in range(len(keys))]
    own = exact.groupBy(*names, "_b").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    told = own.select(*names, "n", "least", "most", "_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_band"))
    at = lambda step, c: F.max(F.when(F.col("_b") - F.col("_band") == step, F.col(c)))
    return told.groupBy(*names, "_band").agg(at(0, "n").alias("_n"), at(0, "least").alias("_least"), at(0, "most").alias("_most"), at(-1, "most").alias("_below"), at(1, "least").alias("_above"))


def close_to_another(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """The rows whose value is closer than ``tolerance`` to that of another row with the same keys."""
    told = bands(rows, [F.col(k) for k in keys], value, tolerance)
    exact, width = F.col(value).cast("decimal(20,2)"), F.lit(tolerance).cast("decimal(20,2)")
    same = _band(F.col(value), tolerance) == F.col("_band")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    near = (F.col("_n") > 1) | (exact - F.col("_below") < width) | (F.col("_above") - exact < width)
    return rows.join(told.where("_n is not null"), same & near, "left_semi")


def referenced(works: DataFrame, letters: DataFrame, client: str = "client_name", tolerance: float = 1000) -> DataFrame:
    """Adds ``referenced``: a letter has the work's package, or its client and a value closer than ``tolerance``.

    Letters meet works by bands of values, one row a band, so a client
    with very many letters and works is no more than their number.
    """
    packages = letters.where("nullif(package_code, '') is not null").select(F.lower("package_code").alias("_package")).distinct().withColumn("_by_package", F.lit(True))
    told = bands(letters, [F.lower("issuing_client")], "contract_value", tolerance)
    exact, width = F.col("contract_value").cast("decimal(20,2)"), F.lit(tolerance).cast("decimal(20,2)")
    close = F.col("_n").isNotNull() | (exact - F.col("_below") < width) | (F.col("_above") - exact < width)
    in_band = (F.lower(client) == F.col("_k0")) & (_band(F.col("contract_value"), tolerance) == F.col("_band"))
    # a band is one row, so a work meets one at most and keeps its own row
    told = told.withColumn("_by_value", F.lit(True))
    out = works.join(packages, F.lower("package_code") == F.col("_package"), "left").join(told, in_band & (F.col("contract_value") != 0) & close, "left")
    return out.withColumn("referenced", F.coalesce("_by_package", "_by_value", F.lit(False))).drop("_package", "_by_package", *told.columns)
