"""Typed records from documents' texts: one select for each kind of document.

Two rule sets exist side by side. ``LABELLED`` reads fields by their labels (key and value in tables, after colons or on
the next line) with patterns as a second way; ``BY_LINE`` reads texts without labels, line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import first_known, found, has_any, lines, strip
from ..functions.dates import dates_named, parse_date
from ..functions.money import cell_value, money_mentions, parse_money
from ..functions.names import letterhead_client, package_code, package_mention, without_parenthesis
from ..functions.text import grading_sentence, table_rows, with_key_values

# Labels of the fields, in their order.
LABELS = {
    "cert_project": ("name of work", "project name", "work", "contract / work order title"),
    "cert_client": ("client / awarding authority", "client name", "client", "employer"),
    "cert_value": ("contract / work order value", "executed value", "awarded value", "contract value (original)", "contract value"),
    "cert_start": ("commencement date", "start date", "original start date"),
    "cert_end": ("completion date", "completion", "actual completion date", "scheduled completion date"),
    "cert_lead": ("contractor's project manager", "project lead", "project manager"),
    "letter_project": ("project title", "work executed", "project name", "work", "name of work"),
    "letter_client": ("issuing authority", "client", "employer"),
    "letter_value": ("contract value", "value", "sanctioned value"),
    "letter_end": ("completion date", "completed", "date of completion"),
    "bond_project": ("project / work name", "work of", "project name", "work"),
    "bond_bank": ("guarantor bank", "issuing bank", "bank"),
    "bond_for": ("beneficiary", "client"),
    "bond_amount": ("guarantee amount", "bond amount"),
    "bond_issue": ("issue date", "date of issue"),
    "bond_end": ("expiry date", "validity", "valid until"),
    "person": ("employee name", "name"),
    "credential": ("credential type", "certification title"),
    "credential_id": ("credential id", "credential / license no."),
    "issued": ("date of issue", "issued"),
    "valid": ("valid through", "validity / expiry"),
    "bill_project": ("project name", "work"),
    "bill_client": ("employer / client", "employer", "client"),
    "bill_no": ("bill no", "bill number"),
    "bill_date": ("date", "bill date"),
    "bill_contract": ("contract value", "awarded value"),
    "bill_value": ("total value of work billed", "net claimed (before client tds)", "value of work done — this bill"),
}
# Words of a letterhead, and beginnings of lines that are none.
LETTERHEAD = ("authority", "department", "dept", "office", "corporation", "corp", "bureau", "board", "limited", "ltd")
NOT_LETTERHEAD = ("no.", "dated", "certificate", "office of")
NOT_ISSUER = ("ref:", "date:", "subject:", "to whomsoever", "this letter", "page ")
# Patterns of the phrases that hold a field, read in any case unless named otherwise.
PHRASES = {
    "cert_project_awarded": r"""work of\s+["“’\'\?]?([^"”’\'\?\n]+?)["“”’\'\?]?(?:\s*\([^)]+\))?,\s*awarded""",
    "cert_project": r"""work\s+(?:of\s+)?["“’\'\?]?([^"”’\'\?\n]+)["“”’\'\?]""",
    "cert_end": r"""completed\s+(?:in all respects\s+)?on\s+([\d]{1,2}[-/\s][\d]{1,2}[-/\s][\d]{2,4}|[\d]{4}-\d{2}-\d{2}|[\d]{1,2}\s+[A-Za-z]+\s+[\d]{4})""",
    "cert_lead": r"""supervised\s+(?:on the contractor\'s side\s+)?by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)""",
    "letter_subject": r"""Subject:.*?[“"’\'\?]?([^”"’\'\?\n]+?Pkg-[A-Za-z0-9-]+)[”"’\'\?]?""",
    "letter_project": r"""for the work\s+[“"’\'\?]?([^”"’\'\?\n]+?)[”"’\'\?]?(?:\s*\((?:INR|Rs))?""",
    "letter_end": r"""(?:completed|finished)\s+(?:on\s+)?([\d]{1,2}[-/\s][\d]{1,2}[-/\s][\d]{2,4}|[\d]{4}-\d{2}-\d{2}|[A-Za-z]+\s+[\d]{1,2},\s+[\d]{4})""",
    "bond_project": r"""work of\s+["“’\'\?]?([^"”’\'\?\n]+?)["“”’\'\?]""",
    "bond_bank": r"""(?:we,)\s+\*\*?([^*]+?(?:Bank|Financial))\*\*?""",
    "bond_for": r"""To:\s*\n+([^\n]+)""",
    "bond_amount": r"""exceeding\s+\*\*?([^*]+?)\*\*?""",
    "bond_issue": r"""Issue Date:\s*([\d]{4}-\d{2}-\d{2}|[\d]{1,2}[-/\s][\d]{1,2}[-/\s][\d]{2,4})""",
    "bond_end": r"""until\s+\*\*?([\d]{4}-\d{2}-\d{2}|[\d]{1,2}[-/\s][\d]{1,2}[-/\s][\d]{2,4})\*\*?""",
    "person": r"""certify that\s*\n+#\s*\*\*([^*]+)\*\*""",
    "employee_id": r"""Employee ID:\s*(EMP-[\d]+)""",
    "credential_id": r"""Credential ID:\s*([A-Za-z0-9-]+)""",
    "issued": r"""Issued:\s*([\d]{4}-\d{2}-\d{2})""",
    "cv_row": r"""\|(?:\d+)?\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|""",
    "bill_client": r"""Contract\s+#[\d]+\s*·\s*([^\n]+)""",
    # the second set, for texts that are read by lines
    "line_project": r"""work of\s+[“"]([^”"]+)[”"]""",
    "line_category": r"""\((buildings|bridges flyovers|water treatment|sewerage drainage|roads maintenance|tunnels|industrial epc|power infra|dam|drainage|large bridges|small buildings)\)""",
    "line_value": r"""executed value of\s+([^(\n]+(?:\([^)]+\))?)""",
    "line_end": r"""completed\s+(?:in all respects\s+)?on\s*([A-Za-z]+\s+\d{1,2},\s*\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]+\s+\d{4})""",
    "line_grade": r"""overall quality of the completed work is graded\s+([A-Za-z]+)""",
    "line_letter_project": r"""for the work\s+[“"]?([^”"\n]+?)[”"]?\s*\((INR|Rs)""",
    "line_person": r"""certify that\s*\n+([A-Z][A-Za-z\s]+)""",
    "line_awarded": r"""awarded to\s+([A-Z][A-Za-z\s]+)""",
    "line_credential": r"""(?:Credential ID|License No|Registration No):\s*([A-Za-z0-9-]+)""",
    "line_issued": r"""(?:Issued|Date of Issue):\s*([\d]{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]+\s+\d{1,2},\s*\d{4})""",
    "line_valid": r"""(?:Valid Through|Expiry Date):\s*([\d]{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]+\s+\d{1,2},\s*\d{4})""",
}
# Patterns whose letters' case counts.
EXACT_PHRASES = {
    "line_lead": r"""supervised on the contractor\'s side by\s+([A-Z][A-Za-z\s]+?)\.""",
    "line_employee": r"""EMP-[\d]+""",
    "line_designation": r"""Designation:\s*([^\n]+)""",
    "line_cv_project": r"""(?:Project|Work):\s*([^\n]+?)\s*·\s*(Pkg-[\d\w-]+)""",
}
SUMMARY, GENERIC_SUMMARY = 500, 1000
# Kinds of documents by parts of their file names, in their order.
FILE_KINDS = (
    ("completion_certificate", ("cc", "completion")), ("reference_letter", ("ref", "recommendation")), ("performance_bond", ("bond", "guarantee")),
    ("personnel_certificate", ("pcert", "personnel")), ("cv", ("cv",)), ("ra_bill", ("bill", "ra")),
)


def _said(text: Column, phrase: str, group: int = 1) -> Column:
    """What a phrase holds, stripped; null where the text does not say it."""
    pattern = EXACT_PHRASES[phrase] if phrase in EXACT_PHRASES else f"(?i){PHRASES[phrase]}"
    return F.nullif(strip(found(text, pattern, group)), F.lit(""))


def kind_of_file(name: Column) -> Column:
    """The kind of a document from its file name; the order of the tests matters. Workbooks by their ending, certificates if nothing fits."""
    low = F.lower(name)
    chosen = F.when(low.endswith(".xlsx"), "workbook").otherwise("completion_certificate")
    for kind, parts in reversed(FILE_KINDS):
        chosen = F.when(has_any(low, parts), kind).otherwise(chosen)
    return chosen


def _plain(line: Column) -> Column:
    return strip(F.regexp_replace(line, "[*#]", ""))


def _first_line(text: Column, test) -> Column:
    return F.try_element_at(F.filter(F.slice(lines(text), 1, 5), test), F.lit(1))


def _starts(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | line.startswith(word)
    return out


def _money(kv: Column, labels: str, text: Column | None) -> tuple[Column, Column]:
    """The raw text and value of an amount: by label, else the text's first mention of money."""
    raw = first_known(kv, LABELS[labels])
    value = parse_money(raw)
    if text is None:
        return raw, value
    first = F.try_element_at(money_mentions(text), F.lit(1))
    return F.when(value.isNotNull(), raw).otherwise(F.coalesce(first["raw"], raw)), F.coalesce(value, first["value"])


def _package(kv: Column, project: Column, text: Column) -> Column:
    return F.coalesce(first_known(kv, ("package code",)), package_mention(F.coalesce(F.nullif(project, F.lit("")), text)))


def _labelled(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return with_key_values(docs.where(F.col("doc_type").isin(*kinds)))


def certificates(docs: DataFrame) -> DataFrame:
    """Completion certificates by labels. docs: doc_id, doc_type, text (null: no fields)."""
    text, kv = F.col("text"), F.col("kv")
    project = F.coalesce(
        first_known(kv, LABELS["cert_project"]),
        _said(text, "cert_project_awarded"),
        _said(text, "cert_project"),
    )
    headed = _first_line(text, lambda line: has_any(F.lower(line), LETTERHEAD) & ~_starts(F.lower(line), NOT_LETTERHEAD))
    client = F.coalesce(first_known(kv, LABELS["cert_client"]), F.nullif(_plain(headed), F.lit("")), F.nullif(_plain(F.try_element_at(lines(text), F.lit(1))), F.lit("")))
    raw, value = _money(kv, "cert_value", text)
    rows = _labelled(docs, ("completion_certificate", "company_completion_certificate")).withColumn("project_name", project)
    return rows.select(
        "doc_id", "doc_type", "project_name", _package(kv, F.col("project_name"), text).alias("package_code"), client.alias("client_name"),
        value.alias("contract_value"), raw.alias("raw_contract_value"), first_known(kv, LABELS["cert_start"]).alias("start_date"),
        F.coalesce(first_known(kv, LABELS["cert_end"]), _said(text, "cert_end")).alias("completion_date"),
        F.coalesce(first_known(kv, LABELS["cert_lead"]), _said(text, "cert_lead")).alias("project_lead"),
        grading_sentence(text).alias("grading_text"),
    )


def reference_letters(docs: DataFrame) -> DataFrame:
    text, kv = F.col("text"), F.col("kv")
    project = F.coalesce(
        first_known(kv, LABELS["letter_project"]),
        _said(text, "letter_subject"),
        _said(text, "letter_project"),
    )
    issuer = _first_line(text, lambda line: ~_starts(F.lower(_plain(line)), NOT_ISSUER))
    raw, value = _money(kv, "letter_value", text)
    rows = _labelled(docs, ("reference_letter",)).withColumn("project_name", project)
    return rows.select(
        "doc_id", "project_name", _package(kv, F.col("project_name"), text).alias("package_code"),
        F.coalesce(first_known(kv, LABELS["letter_client"]), _plain(issuer)).alias("issuing_client"), value.alias("contract_value"), raw.alias("raw_contract_value"),
        F.coalesce(first_known(kv, LABELS["letter_end"]), _said(text, "letter_end")).alias("completion_date"),
        F.substring(text, 1, SUMMARY).alias("recommendation_summary"),
    )


def performance_bonds(docs: DataFrame) -> DataFrame:
    text, kv = F.col("text"), F.col("kv")
    project = F.coalesce(first_known(kv, LABELS["bond_project"]), _said(text, "bond_project"))
    bank_line = F.try_element_at(F.filter(F.slice(F.split(text, "\n"), 1, 5), lambda line: F.contains(F.lower(line), F.lit("bank"))), F.lit(1))
    labelled = first_known(kv, LABELS["bond_amount"])
    stated = _said(text, "bond_amount")
    raw = F.when(parse_money(labelled).isNotNull(), labelled).otherwise(F.coalesce(stated, labelled))
    rows = _labelled(docs, ("performance_bond",)).withColumn("project_name", project)
    return rows.select(
        "doc_id", "project_name", _package(kv, F.col("project_name"), text).alias("package_code"),
        F.coalesce(first_known(kv, LABELS["bond_bank"]), _said(text, "bond_bank"), _plain(bank_line)).alias("issuing_bank"),
        F.coalesce(first_known(kv, LABELS["bond_for"]), _said(text, "bond_for")).alias("beneficiary"),
        parse_money(raw).alias("guarantee_amount"), raw.alias("raw_guarantee_amount"),
        F.coalesce(first_known(kv, LABELS["bond_issue"]), _said(text, "bond_issue")).alias("issue_date"),
        F.coalesce(first_known(kv, LABELS["bond_end"]), _said(text, "bond_end")).alias("expiry_date"),
    )


def credential_type(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("PMP")), "PMP").when(F.contains(text, F.lit("Six Sigma")), "Six Sigma Black Belt")


def personnel_certificates(docs: DataFrame) -> DataFrame:
    text, kv = F.col("text"), F.col("kv")
    return _labelled(docs, ("personnel_certificate",)).select(
        "doc_id",
        F.coalesce(first_known(kv, LABELS["person"]), _said(text, "person")).alias("engineer_name"),
        F.coalesce(first_known(kv, ("employee id",)), _said(text, "employee_id")).alias("employee_id"),
        F.coalesce(first_known(kv, LABELS["credential"]), credential_type(text)).alias("certification_type"),
        F.coalesce(first_known(kv, LABELS["credential_id"]), _said(text, "credential_id")).alias("credential_id"),
        F.coalesce(first_known(kv, LABELS["issued"]), _said(text, "issued")).alias("issue_date"),
        first_known(kv, LABELS["valid"]).alias("expiry_date"),
    )


def cvs(docs: DataFrame) -> DataFrame:
    """CVs with projects_led, from table rows of four cells after an optional number."""
    text, kv = F.col("text"), F.col("kv")
    names = ("project_name", "package_code", "client", "role")
    columns = [F.regexp_extract_all(text, F.lit(PHRASES["cv_row"]), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    led = F.transform(F.arrays_zip(*columns), lambda r: F.struct(*[strip(r[n]).alias(n) for n in names]))
    led = F.filter(led, lambda r: ~r["project_name"].startswith("---") & ~F.contains(F.lower(r["project_name"]), F.lit("project name")))
    fields = (("engineer_name", "name"), ("employee_id", "employee id"), ("designation", "designation"), ("total_experience", "total experience"), ("qualification", "qualification"))
    return _labelled(docs, ("cv",)).select("doc_id", *[first_known(kv, (label,)).alias(name) for name, label in fields], led.alias("projects_led"))


def bills(docs: DataFrame) -> DataFrame:
    """Running and final bills with their items, from table rows of six cells."""
    text, kv = F.col("text"), F.col("kv")
    raw, value = _money(kv, "bill_contract", None)
    _, billed = _money(kv, "bill_value", text)
    items = F.filter(table_rows(text, 6), lambda r: ~F.lower(F.replace(r[0], F.lit("*"), F.lit(""))).isin("", "item"))
    items = F.transform(items, lambda r: F.struct(F.replace(r[0], F.lit("*"), F.lit("")).alias("item_no"), r[1].alias("description"), r[2].alias("unit"), cell_value(r[3]).alias("rate"), cell_value(r[4]).alias("qty"), cell_value(r[5]).alias("amount")))
    return _labelled(docs, ("ra_bill", "final_ra_bill")).select(
        "doc_id", "doc_type", first_known(kv, LABELS["bill_project"]).alias("project_name"), first_known(kv, ("package code",)).alias("package_code"),
        F.coalesce(first_known(kv, LABELS["bill_client"]), _said(text, "bill_client")).alias("client_name"),
        first_known(kv, LABELS["bill_no"]).alias("bill_number"), first_known(kv, LABELS["bill_date"]).alias("bill_date"),
        value.alias("contract_value"), billed.alias("billed_value"), items.alias("boq_items"),
    )


def generic(docs: DataFrame) -> DataFrame:
    """Any other document: its labels, amounts, dates and beginning."""
    text = F.col("text")
    return with_key_values(docs, name="key_values").select("doc_id", "doc_type", "key_values", money_mentions(text).alias("money_mentions"), dates_named(text).alias("extracted_dates"), F.substring(text, 1, GENERIC_SUMMARY).alias("summary_text"))


def _next_line(all_lines: Column, test, fits=None) -> Column:
    """The line after the first one that passes ``test`` and whose next line ``fits``."""
    pairs = F.arrays_zip(F.slice(all_lines, 1, F.greatest(F.size(all_lines) - 1, F.lit(0))).alias("k"), F.slice(all_lines, 2, F.size(all_lines)).alias("v"))
    hits = F.filter(pairs, lambda p: test(F.lower(p["k"])) & (fits(p["v"]) if fits else F.lit(True)))
    return F.try_element_at(hits, F.lit(1))["v"]


def _with_lines(docs: DataFrame, *kinds: str) -> DataFrame:
    return docs.where(F.col("doc_type").isin(*kinds)).withColumn("_lines", F.coalesce(lines(F.col("text")), F.array().cast("array<string>")))


def _letterhead() -> Column:
    return letterhead_client(F.try_element_at("_lines", F.lit(1)), F.try_element_at("_lines", F.lit(2)))


def _first_mention(text: Column) -> Column:
    return F.try_element_at(money_mentions(text), F.lit(1))["value"]


def line_certificates(docs: DataFrame) -> DataFrame:
    """Completion certificates by lines: a label stands alone and its value on the next line; phrases come before or after, as the field has it. A null text has no fields."""
    text, all_lines = F.col("text"), F.col("_lines")
    starts = lambda line, word: F.startswith(F.lower(line), F.lit(word))
    has = lambda line, word: F.contains(line, F.lit(word))
    named = _next_line(all_lines, lambda k: k.isin("name of work", "particulars of the work"), lambda v: ~starts(v, "nature"))
    worth = _next_line(all_lines, lambda k: has(k, "contract value") | has(k, "executed value"), lambda v: F.coalesce(parse_money(v) != 0, F.lit(False)))
    completed = F.filter(F.transform(F.arrays_zip(F.slice(all_lines, 1, F.greatest(F.size(all_lines) - 1, F.lit(0))).alias("k"), F.slice(all_lines, 2, F.size(all_lines)).alias("v")), lambda p: F.when(F.lower(p["k"]).isin("completion date", "actual completion date"), parse_date(p["v"], loose=True))), lambda d: d.isNotNull())
    manager = _next_line(all_lines, lambda k: has(k, "contractor") & has(k, "manager"), lambda v: (F.length(v) < 40) & ~starts(v, "national"))
    triples = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), all_lines).alias("before"), all_lines.alias("line"), F.slice(all_lines, 2, F.size(all_lines)).alias("after"))
    signed = F.filter(triples, lambda t: (F.lower(t["line"]) == "project manager") & has(F.lower(t["after"]), "national infra") & t["before"].isNotNull())
    rows = _with_lines(docs, "completion_certificate", "company_completion_certificate")
    rows = rows.withColumn("project_name", strip(without_parenthesis(F.coalesce(named, _said(text, "line_project")))))
    return rows.select(
        "doc_id", "doc_type", "project_name", package_code(F.col("project_name")).alias("package_code"), _letterhead().alias("client_name"),
        F.coalesce(_next_line(all_lines, lambda k: has(k, "category")), _said(text, "line_category")).alias("category"),
        F.coalesce(parse_money(worth), parse_money(_said(text, "line_value")), _first_mention(text)).alias("contract_value"),
        F.coalesce(parse_date(_said(text, "line_end"), loose=True), F.try_element_at(completed, F.lit(1))).alias("completion_date"),
        F.coalesce(manager, _said(text, "line_lead"), F.try_element_at(signed, F.lit(1))["before"]).alias("project_lead"),
        _said(text, "line_grade").alias("grade"),
    )


def line_letters(docs: DataFrame) -> DataFrame:
    """Reference letters by lines."""
    text, all_lines = F.col("text"), F.col("_lines")
    project = F.coalesce(_said(text, "line_letter_project"), _next_line(all_lines, lambda k: k.isin("name of work", "project title", "work")))
    rows = _with_lines(docs, "reference_letter").withColumn("project_name", project)
    return rows.select("doc_id", "project_name", package_code(F.col("project_name")).alias("package_code"), _letterhead().alias("issuing_client"), _first_mention(text).alias("contract_value"), parse_date(text).alias("completion_date"))


def line_bonds(docs: DataFrame) -> DataFrame:
    """Performance bonds by lines: their amount is the first that the text names."""
    return docs.where("doc_type = 'performance_bond'").select("doc_id", _first_mention(F.col("text")).alias("guarantee_amount"))


def line_personnel(docs: DataFrame) -> DataFrame:
    """Personnel certificates by phrases."""
    text = F.col("text")
    kind = F.when(F.contains(text, F.lit("PMP")) | F.contains(text, F.lit("Project Management Professional")), "PMP").when(F.contains(text, F.lit("Six Sigma")), "Six Sigma Black Belt")
    return docs.where("doc_type = 'personnel_certificate'").select(
        "doc_id", F.coalesce(_said(text, "line_person"), _said(text, "line_awarded")).alias("engineer_name"), _said(text, "employee_id").alias("employee_id"), kind.alias("certification_type"),
        _said(text, "line_credential").alias("credential_id"), parse_date(_said(text, "line_issued"), loose=True).alias("issue_date"), parse_date(_said(text, "line_valid"), loose=True).alias("expiry_date"),
    )


def line_cvs(docs: DataFrame) -> DataFrame:
    """CVs by lines: doc_id, engineer_name, employee_id, designation."""
    text, all_lines = F.col("text"), F.col("_lines")
    headed = strip(F.replace(F.try_element_at(all_lines, F.lit(1)), F.lit("CURRICULUM VITAE"), F.lit("")))
    name = F.coalesce(_next_line(all_lines, lambda k: k.isin("name", "full name", "curriculum vitae")), headed)
    return _with_lines(docs, "cv").select("doc_id", name.alias("engineer_name"), _said(text, "line_employee", 0).alias("employee_id"), _said(text, "line_designation").alias("designation"))


def line_cv_projects(docs: DataFrame) -> DataFrame:
    """The projects that CVs name with a package: doc_id, engineer_name, project_name, package_code."""
    names, codes = (F.transform(F.regexp_extract_all("text", F.lit(EXACT_PHRASES["line_cv_project"]), F.lit(i)), strip) for i in (1, 2))
    pairs = F.explode(F.arrays_zip(names.alias("project_name"), codes.alias("package_code")))
    listed = docs.where("doc_type = 'cv'").select("doc_id", pairs.alias("p"))
    return listed.join(line_cvs(docs).select("doc_id", "engineer_name"), "doc_id").select("doc_id", "engineer_name", "p.project_name", "p.package_code")


LABELLED = {"certificates": certificates, "reference_letters": reference_letters, "performance_bonds": performance_bonds, "personnel_certificates": personnel_certificates, "cvs": cvs, "bills": bills}
BY_LINE = {"certificates": line_certificates, "reference_letters": line_letters, "performance_bonds": line_bonds, "personnel_certificates": line_personnel, "cvs": line_cvs, "cv_projects": line_cv_projects}
