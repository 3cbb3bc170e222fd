"""Reading documents, answers and logs; all schemas are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.extract import kind_of_file
from .csv_text import submission as submission
from .workbook import column_letters

INDEX = "doc_id string, doc_type string, filename string, size_bytes bigint"
ENVELOPE = "doc_id string, doc_type string, filename string, size_bytes bigint, char_count bigint, page_count bigint, extraction_warnings array<string>, extracted_data string, _corrupt_record string"
CERTIFICATE = "project_name string, package_code string, client_name string, contract_value double, raw_contract_value string, start_date string, completion_date string, project_lead string, grading_text string"
LETTER = "project_name string, package_code string, issuing_client string, contract_value double, raw_contract_value string, completion_date string, recommendation_summary string"
BOND = "project_name string, package_code string, issuing_bank string, beneficiary string, guarantee_amount double, raw_guarantee_amount string, issue_date string, expiry_date string"
PERSONNEL = "engineer_name string, employee_id string, certification_type string, credential_id string, issue_date string, expiry_date string"
CV = "engineer_name string, employee_id string, designation string, total_experience string, qualification string, projects_led array<struct<project_name: string, package_code: string, client: string, role: string>>"
BILL = "project_name string, package_code string, client_name string, bill_number string, bill_date string, contract_value double, billed_value double, boq_items array<struct<item_no: string, description: string, unit: string, rate: double, qty: double, amount: double>>"
GENERIC = "key_values map<string, string>, money_mentions array<array<string>>, extracted_dates array<string>, summary_text string"
PAYLOADS = {
    "completion_certificate": CERTIFICATE, "company_completion_certificate": CERTIFICATE, "reference_letter": LETTER, "performance_bond": BOND,
    "personnel_certificate": PERSONNEL, "cv": CV, "ra_bill": BILL, "final_ra_bill": BILL,
}
QUESTION = "array<struct<qid: string, question_id: string, question: string, answer_type: string, shape: string, hops: int, answer: double, answer_gold: double, scored: boolean>>"


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).csv(path, header=True)


def walk(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of a folder without an index: PDFs, workbooks and CSVs at any depth, without lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,xlsx,csv}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~name.startswith("~$")).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("doc_id"), name.alias("filename"), F.col("length").alias("size_bytes"), "path")
    return rows.withColumn("doc_type", kind_of_file(F.col("filename")))


def texts(spark: SparkSession, path: str, separator: str = "\n\n") -> DataFrame:
    """Texts of documents, one file each: doc_id, text, char_count, page_count, warning. Pages are cut by form feeds and joined by ``separator``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("filename"))
    pages = F.split("value", "\f")
    rows = files.select(F.regexp_replace("filename", r"\.[^.]+$", "").alias("doc_id"), F.array_join(pages, separator).alias("text"), F.size(pages).alias("page_count"))
    return rows.withColumn("char_count", F.length("text")).withColumn("warning", F.when(F.col("text") == "", "EXTRACTION_FAILED: no text"))


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents, one JSON file each; unreadable ones are left out. The payload stays JSON text until its kind is known."""
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("doc_id is not null and _corrupt_record is null").drop("_corrupt_record")


def document(rows: DataFrame, doc_id: str) -> DataFrame:
    return rows.where(F.col("doc_id") == doc_id)


def payload(rows: DataFrame, doc_type: str) -> DataFrame:
    """The typed records of one kind: doc_id, doc_type and the kind's fields."""
    parsed = rows.where(F.col("doc_type") == doc_type).select("doc_id", "doc_type", F.from_json("extracted_data", PAYLOADS.get(doc_type, GENERIC)).alias("d"))
    return parsed.select("doc_id", "doc_type", "d.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON file: a bare list, or one under ``questions`` or ``answers``; ids under qid or question_id."""
    raw = spark.read.text(path, wholetext=True)
    w = F.from_json("value", f"questions {QUESTION}, answers {QUESTION}")
    bare = F.ltrim("value").startswith("[")
    items = F.when(bare, F.from_json("value", QUESTION)).otherwise(F.coalesce(w["questions"], w["answers"]))
    rows = raw.select(F.explode(items).alias("q")).select("q.*")
    return rows.select(F.coalesce("qid", "question_id").alias("qid"), "question", "answer_type", "shape", "hops", F.coalesce("answer", "answer_gold").alias("gold"), F.coalesce("scored", F.lit(True)).alias("scored"))


def answer_lines(spark: SparkSession, path: str) -> DataFrame:
    """qid, raw_answer, row_num of JSON lines; a malformed line or one without an id fails the read."""
    rows = spark.read.schema("qid string, question_id string, answer string").option("mode", "FAILFAST").json(path).withColumn("row_num", F.monotonically_increasing_id())
    qid = F.coalesce("qid", "question_id")
    return rows.select(F.when(qid.isNull(), F.raise_error(F.lit("a line has no qid"))).otherwise(qid).alias("qid"), F.col("answer").alias("raw_answer"), "row_num")


def log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log of JSON lines; blank lines are skipped, bad ones flagged."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", "doc_id string, status string, warnings array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return rows.select(parsed.alias("r")).select("r.doc_id", "r.status", "r.warnings", F.col("r._bad").isNotNull().alias("bad"))


def sheet_rows(sheets: DataFrame, most: int = 500) -> DataFrame:
    """Cells of workbooks: sheets (doc_id, sheet, values, formulas: arrays of rows) to row_no, column, value.

    Of two parallel grids the cached value stands, else the formula's text; rows above ``most`` are left out, as the
    workbooks' format has it.
    """
    rows = sheets.select("doc_id", "sheet", F.posexplode(F.slice(F.arrays_zip("values", "formulas"), 1, most)).alias("row_no", "r"))
    cells = rows.select("doc_id", "sheet", "row_no", F.posexplode(F.arrays_zip(F.col("r.values").alias("v"), F.col("r.formulas").alias("f"))).alias("at", "c"))
    return cells.select("doc_id", "sheet", "row_no", column_letter(F.col("at")).alias("column"), F.coalesce("c.v", "c.f").alias("value"))


def column_letter(at):
    """A spreadsheet column's letters from its place, counted from 0."""
    return column_letters(at + 1)


def receivables(rows: DataFrame) -> DataFrame:
    """client_name, invoiced, received: sums over a sheet's rows, nulls counting as 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("decimal(18,2)"), zero)).alias(c)
    return rows.where("client_name is not null").groupBy("client_name").agg(total("invoiced"), total("received"))
