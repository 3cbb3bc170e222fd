"""The library's functions for use in SQL text: their bodies are expressions that the optimizer sees, not Python."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .answers import score_one
from .money import MENTION, amount_of, bare_amount, unit_of
from .names import normalize_mention
from .text import BOLD, CELLS, PLAIN


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def body_of(spark: SparkSession, expression: Column, parameters: str) -> str:
    """The SQL text of a column expression over named parameters."""
    empty = spark.createDataFrame([], parameters)
    return empty.select(expression.alias("body"))._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session's SQL.

    parse_money(text) and normalize_mention(text) are a number and a text, score_one(gold, got) a number,
    money_mentions(text) an array of (raw, value), and label_pairs(text) a table of kind, place, label and value: what stands in
    table cells (1), after bold labels (2), after plain ones (3) and on the line after another (4).
    """
    # parse_money with its steps bound by name, so that each is worked out once; the text of a lambda of a Column cannot be had
    bare, unit, amount = body_of(spark, bare_amount(F.col("m")), "m string"), body_of(spark, unit_of(F.col("b")), "b string"), body_of(spark, amount_of(F.col("b"), F.col("u")), "b string, u string")
    money = f"transform(array({bare}), b -> transform(array({unit}), u -> {amount})[0])[0]"
    scalar = {
        "parse_money(m STRING) RETURNS DOUBLE": money,
        "normalize_mention(m STRING) RETURNS STRING": body_of(spark, normalize_mention(F.col("m")), "m string"),
        "score_one(gold DOUBLE, got DOUBLE) RETURNS DOUBLE": body_of(spark, score_one(F.col("gold"), F.col("got")), "gold double, got double"),
        "money_mentions(t STRING) RETURNS ARRAY<STRUCT<raw: STRING, value: DOUBLE>>": f"filter(transform(regexp_extract_all(t, {_literal(MENTION)}, 0), m -> named_struct('raw', m, 'value', {money})), x -> x.value IS NOT NULL)",
    }
    for head, body in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    plain = lambda c: f"regexp_replace(regexp_replace({c}, '[*_]', ''), '^\\\\s+|\\\\s+$', '')"
    parts = []
    for kind, pattern in ((1, CELLS), (2, BOLD), (3, PLAIN)):
        zipped = f"arrays_zip(regexp_extract_all(t, {_literal(pattern)}, 1), regexp_extract_all(t, {_literal(pattern)}, 2))"
        rule = " AND NOT startswith(label, '---')" if kind == 1 else ""
        parts.append(f"SELECT kind, place, label, value FROM (SELECT {kind} AS kind, pos AS place, lower({plain('col.`0`')}) AS label, {plain('col.`1`')} AS value FROM posexplode({zipped})) WHERE label <> '' AND value <> ''{rule}")
    lines = "filter(transform(split(t, '\\n'), l -> regexp_replace(l, '^\\\\s+|\\\\s+$', '')), l -> l <> '')"
    following = f"SELECT 4 AS kind, pos AS place, lower({plain('col.`0`')}) AS label, {plain('col.`1`')} AS value FROM posexplode(arrays_zip({lines}, slice({lines}, 2, size({lines}))))"
    parts.append(f"SELECT kind, place, label, value FROM ({following}) WHERE value IS NOT NULL AND length(label) < 50")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION label_pairs(t STRING) RETURNS TABLE (kind INT, place INT, label STRING, value STRING) RETURN {' UNION ALL '.join(parts)}")
