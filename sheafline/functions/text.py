"""Fields and sentences of a document's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import has_any, lines, once, strip

# A label's value stands in a table cell, after a bold label, after a plain label, or on the next line. The first two
# kinds overwrite what is known of a label, the last two only add.


# Patterns of a label and its value in a table's cells, after a bold label, and after a plain one.
CELLS = r"\|(?:\*\*)?([^|]+?)(?:\*\*)?\|([^|\n]+)\|"
BOLD = r"\*\*(.+?):\*\*\s*(.+)"
PLAIN = r"(?m)^\s*([A-Za-z0-9\s/_\-\(\)']+):\s*(.+)"


def _bare(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[*_]", ""))


def _pairs(text: Column, pattern: str, kind: int) -> Column:
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(F.lit(kind).alias("kind"), F.lower(_bare(p["k"])).alias("k"), _bare(p["v"]).alias("v")))


def label_pairs(text: Column) -> Column:
    """All label and value pairs, in the order of their weight."""
    cells = F.filter(_pairs(text, CELLS, 1), lambda p: ~p["k"].startswith("---") & (p["k"] != "") & (p["v"] != ""))
    bold = F.filter(_pairs(text, BOLD, 2), lambda p: (p["k"] != "") & (p["v"] != ""))
    plain = F.filter(_pairs(text, PLAIN, 3), lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.concat(cells, bold, plain, F.filter(once(lines(text), _next_lines), lambda p: F.length(p["k"]) < 50))


def _next_lines(all_lines: Column) -> Column:
    following = F.slice(all_lines, 2, F.greatest(F.size(all_lines) - 1, F.lit(0)))
    zipped = F.arrays_zip(F.slice(all_lines, 1, F.size(following)).alias("k"), following.alias("v"))
    return F.transform(zipped, lambda p: F.struct(F.lit(4).alias("kind"), F.lower(_bare(p["k"])).alias("k"), _bare(p["v"]).alias("v")))


def _ordered(pairs: Column) -> Column:
    """Pairs so that the first of a label is the one that holds: of table cells and bold labels the last, of others the first."""
    return F.concat(F.reverse(F.filter(pairs, lambda p: p["kind"] <= 2)), F.filter(pairs, lambda p: p["kind"] > 2))


def _first_of_each(ordered: Column) -> Column:
    keys = F.filter(F.array_distinct(F.transform(ordered, lambda p: p["k"])), lambda k: k.isNotNull())
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(ordered, lambda p: p["k"] == k), 1)["v"].alias("value")))
    return F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))


def with_key_values(rows: DataFrame, text: str = "text", name: str = "kv") -> DataFrame:
    """Adds a map from label to value; a null text has none.

    The pairs are bound within the expression, for a column of its own does not keep them: a condition on the map, such as
    the one that Spark adds below an explode, moves down with the pairs in the place of each of their names, and reads the
    text again for every label.
    """
    return rows.withColumn(name, once(label_pairs(F.col(text)), lambda pairs: once(_ordered(pairs), _first_of_each)))


def grading_sentence(text: Column) -> Column:
    """The first sentence of more than 15 characters about the grading, or else about satisfactory workmanship."""
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: strip(F.replace(s, F.lit("\n"), F.lit(" "))))
    sentences = F.filter(sentences, lambda s: F.length(s) > 15)
    graded = F.filter(sentences, lambda s: has_any(F.lower(s), ("graded", "quality of the completed work", "overall quality")))
    sound = F.filter(sentences, lambda s: F.contains(F.lower(s), F.lit("workmanship")) & F.contains(F.lower(s), F.lit("satisfactory")))
    return F.coalesce(F.try_element_at(graded, F.lit(1)), F.try_element_at(sound, F.lit(1)))


def line_after(text: Column, label: str) -> Column:
    """The line after the first one that is the label (any case)."""
    rows = lines(text)
    at = F.array_position(F.transform(rows, F.lower), F.lit(label.lower()))
    return F.when(at > 0, F.try_element_at(rows, (at + 1).cast("int")))


def line_before(text: Column, part: str) -> Column:
    """The line before the first one that holds the part (any case)."""
    rows = lines(text)
    at = F.array_position(F.transform(rows, lambda line: F.contains(F.lower(line), F.lit(part.lower()))), F.lit(True))
    return F.when(at > 1, F.try_element_at(rows, (at - 1).cast("int")))


def table_rows(text: Column, cells: int) -> Column:
    """Rows of a table with so many cells: array of arrays of stripped cells, without rules and headings' rules."""
    pattern = r"\|" + r"([^|\n]*)\|" * cells
    columns = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(cells)]
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.transform(zipped, lambda r: F.array(*[strip(r[f"c{i}"]) for i in range(cells)]))
    return F.filter(rows, lambda r: ~F.element_at(r, 1).startswith("---") & ~F.element_at(r, 2).startswith("---"))
