"""Workbooks (XLSX): the container is opened where the file is read, all else is native functions on its XML parts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet that are kept.
ROWS = 500

_SHEET = "sheetData struct<row: array<struct<_r: int, c: array<struct<_r: string, _t: string, v: string, f: string, `is`: struct<t: string, r: array<struct<t: string>>>>>>>>"
_STRINGS = "si array<struct<t: string, r: array<struct<t: string>>>>"
_BOOK = "sheets struct<sheet: array<struct<_name: string, _id: string>>>"
_LINKS = "Relationship array<struct<_Id: string, _Target: string>>"
_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The XML parts of all workbooks at a path: doc_id, name, text, warning.

    A file that is no container gives one row without a name, whose warning says so.
    """

    def opened(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for doc_id, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        found = [(doc_id, name, book.read(name).decode(), None) for name in book.namelist() if name.startswith("xl/") and name.endswith((".xml", ".rels"))]
                except (zipfile.BadZipFile, UnicodeDecodeError) as error:
                    found = [(doc_id, None, None, f"workbook cannot be opened: {error}")]
                for row in found:  # a part at a time: one sheet may be large
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["doc_id", "name", "text", "warning"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return files.select(name.alias("doc_id"), "content").mapInArrow(opened, "doc_id string, name string, text string, warning string")


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number, counted from 1, from its letters, however many."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """The reverse: letters are digits from 1 to 26."""
    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("text"))

    def step(state: Column, _: Column) -> Column:
        n = state["n"] - 1
        return F.when(state["n"] > 0, F.struct(F.floor(n / 26).alias("n"), F.concat(F.char(65 + n % 26), state["text"]).alias("text"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["text"])


def _sheet_names(parts: DataFrame) -> DataFrame:
    """doc_id, name (of the part), sheet, position: the title of each sheet, by the workbook's own links; a part without one has its file's name."""
    links = parts.where("name = 'xl/_rels/workbook.xml.rels'").select("doc_id", F.explode(F.from_xml("text", _LINKS, _OPTIONS)["Relationship"]).alias("l"))
    links = links.select("doc_id", F.col("l._Id").alias("id"), F.concat(F.lit("xl/"), F.regexp_replace("l._Target", "^/?(xl/)?", "")).alias("name"))
    book = parts.where("name = 'xl/workbook.xml'").select("doc_id", F.posexplode(F.from_xml("text", _BOOK, _OPTIONS)["sheets"]["sheet"]).alias("position", "s"))
    return book.select("doc_id", "position", F.col("s._name").alias("sheet"), F.col("s._id").alias("id")).join(links, ["doc_id", "id"]).select("doc_id", "name", "sheet", "position")


def cells(parts: DataFrame) -> DataFrame:
    """doc_id, sheet, row_no, column_no, column, value, formula of every cell that holds anything.

    parts: doc_id, name, text. Shared strings are joined by their numbers; of a formula the cached value counts, which
    is null where the file has none. A cell or row without a reference comes after the one before it.
    """
    text_of = lambda s: F.coalesce(s["t"], F.array_join(F.transform(s["r"], lambda r: F.coalesce(r["t"], F.lit(""))), ""))
    strings = parts.where("name = 'xl/sharedStrings.xml'").select("doc_id", F.posexplode(F.from_xml("text", _STRINGS, _OPTIONS)["si"]).alias("number", "s")).select("doc_id", "number", text_of(F.col("s")).alias("shared"))
    sheets = parts.where("name like 'xl/worksheets/%.xml'").select("doc_id", "name", F.posexplode(F.from_xml("text", _SHEET, _OPTIONS)["sheetData"]["row"]).alias("at", "row"))
    found = sheets.select("doc_id", "name", F.coalesce("row._r", F.col("at") + 1).alias("row_no"), F.posexplode("row.c").alias("place", "c"))
    letters = F.regexp_extract("c._r", "^([A-Za-z]+)", 1)
    number = F.when(letters != "", column_number(letters)).otherwise(F.col("place") + 1)
    found = found.select("doc_id", "name", "row_no", number.alias("column_no"), F.col("c._t").alias("kind"), F.nullif("c.v", F.lit("")).alias("v"), F.col("c.f").alias("formula"), text_of(F.col("c.is")).alias("inline"))
    found = found.withColumn("number", F.when(F.col("kind") == "s", F.col("v").try_cast("int")))
    found = found.join(strings, ["doc_id", "number"], "left").join(_sheet_names(parts), ["doc_id", "name"], "left")
    plain = F.regexp_replace("v", r"^(-?\d+)\.0+$", "$1")
    value = F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("inline")).when(F.col("kind") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE")).when(F.col("kind").isin("str", "e"), F.col("v")).otherwise(plain)
    title = F.coalesce("sheet", F.regexp_extract("name", r"([^/]+)\.xml$", 1))
    rows = found.select("doc_id", title.alias("sheet"), "row_no", "column_no", column_letters(F.col("column_no")).alias("column"), value.alias("value"), "formula")
    return rows.where("value is not null or formula is not null")


def unresolved(found: DataFrame) -> DataFrame:
    """doc_id, warning of each formula without a cached value; formulas are not worked out."""
    place = F.concat(F.lit("Unresolved formula cell at '"), F.col("sheet"), F.lit("'!"), F.col("column"), F.col("row_no").cast("string"))
    return found.where("formula is not null and value is null").select("doc_id", place.alias("warning"))


def tables(found: DataFrame, most: int = ROWS) -> DataFrame:
    """doc_id, sheet, headers, row_count, rows of every sheet: its first row as headings (col_0, col_1 where empty), all rows counted, ``most`` of them kept."""
    size = found.groupBy("doc_id", "sheet").agg(F.max("row_no").alias("row_count"), F.max("column_no").alias("width"))
    rows = found.where(F.col("row_no") <= most).groupBy("doc_id", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column_no", "value"))).alias("cells"))
    kept = rows.groupBy("doc_id", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("row_no", "cells"))).alias("kept"))
    wide = size.join(kept, ["doc_id", "sheet"], "left").withColumn("kept", F.coalesce("kept", F.create_map().cast("map<int,map<bigint,string>>")))
    row = lambda n: F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("width")), lambda c: F.try_element_at(F.try_element_at("kept", n), c))
    every = F.transform(F.sequence(F.lit(1), F.least("row_count", F.lit(most))), row)
    headers = F.transform(row(F.lit(1)), lambda v, i: F.coalesce(v, F.concat(F.lit("col_"), i.cast("string"))))
    return wide.select("doc_id", "sheet", headers.alias("headers"), "row_count", every.alias("rows"))
