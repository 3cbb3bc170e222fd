"""Expressions against tables of known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from sheafline.functions import answers, basic, dates, money, names, text
from sheafline.plans import extract
from sheafline.sources import column_letter


def results(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_money_is_exact(spark):
    cases = {"INR 10.13 Cr": 101300000.0, "Rs.5 lakh": 500000.0, "₹ 1,00,000/-": 100000.0, "2 CRORES": 20000000.0, "7k": 7000.0, "1_000": 1000.0, "+5": 5.0, ".5": 0.5, "5d": None, "12 apples": None, "INR": None}
    assert results(spark, list(cases), money.parse_money) == list(cases.values())


def test_mentions_in_order(spark):
    found = results(spark, ["INR 5 Cr, later 20 lakhs; 40 people; Rs. 3,000/-"], money.money_mentions)[0]
    assert [(m["raw"], m["value"]) for m in found] == [("INR 5 Cr", 5e7), ("20 lakhs", 2e6), ("Rs. 3,000/-", 3000.0)]


def test_cells_and_words(spark):
    assert results(spark, ["12.5", "Rs. 2 lakh", "x", None], money.cell_value) == [12.5, 200000.0, None, None]
    assert results(spark, ["two crore ten lakh", "three hundred", "hundred"], money.number_in_words) == [21000000.0, 300.0, None]


def test_dates(spark):
    import datetime

    day = datetime.date(2021, 3, 5)
    assert results(spark, ["March 5, 2021", "5 Mar 2021", "x 2021-03-05 y", "5/3/2021", "2021-02-31", "May 1 2020\n2021-03-05"], dates.parse_date) == [day, day, day, day, None, datetime.date(2020, 5, 1)]
    assert results(spark, ["2021-03-05", "on 2021-03-05"], dates.strict_iso) == [day, None]
    assert results(spark, ["from 2019 to 2021, not 1999 or 20211"], dates.years_named) == [[2019, 2021]]


def test_scores(spark):
    cases = [(100.0, 100.0, 1.0), (100.0, 95.0, 0.95), (100.0, 150.0, 0.5), (100.0, 300.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (100.0, None, 0.0), (100.0, float("nan"), 0.0), (100.0, float("inf"), 0.0), (-100.0, -90.0, 0.9), (None, 1.0, 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, gold double, got double, want double")
    for r in rows.select("want", answers.score_one(F.col("gold"), F.col("got")).alias("score")).collect():
        assert r["score"] == pytest.approx(r["want"])


def test_issues_and_repair(spark):
    cases = [
        ("percent", 101.0, ["OUT_OF_BOUNDS_PERCENT"], 100.0), ("percent", 0.9019, ["FRACTION_PERCENT_SUSPECTED"], 90.19), ("percent", 50.0, [], 50.0), ("days", -1.0, ["NEGATIVE_DAYS"], 0.0),
        ("days", 18251.0, ["SUSPICIOUS_DAYS"], 18251.0), ("count", 2.5, ["NON_INTEGER_COUNT"], 2.0), ("count", -1.0, ["NEGATIVE_COUNT"], 0.0), ("money", -5.0, ["NEGATIVE_MONEY"], 0.0),
        ("money", 2e11, ["SUSPICIOUS_HIGH_MONEY"], 2e11), ("money", None, ["INVALID_NUMBER"], 1e8), ("percent", None, ["INVALID_NUMBER"], 50.0), ("other", None, ["INVALID_NUMBER"], 0.0), ("money", 0.285, [], 0.29),
    ]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, *_) in enumerate(cases)], "i int, k string, v double")
    found = rows.select("i", answers.issues(F.col("v"), F.col("k")).alias("codes"), answers.repaired(F.col("v"), F.col("k")).alias("r")).orderBy("i").collect()
    assert [(r["codes"], r["r"]) for r in found] == [(c[2], c[3]) for c in cases]


def test_bounds_of_the_baseline(spark):
    cases = [("percent", -1.0, 0.0), ("percent", 0.5, 50.0), ("percent", 120.0, 50.0), ("days", 20000.0, 730.0), ("count", 10001.0, 2.0), ("money", -1.0, 1e8), ("money", 5.0, 5.0)]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, k string, v double")
    assert [r["r"] for r in rows.select("i", answers.bounded(F.col("v"), F.col("k")).alias("r")).orderBy("i").collect()] == [c[2] for c in cases]


def test_answer_text(spark):
    assert results(spark, [5.0, 2.345, 526919875000.0], answers.answer_text, "double") == ["5", "2.35", "526919875000"]


def test_names(spark):
    assert results(spark, ["GOVT OF WEST BENGAL"], lambda v: names.letterhead_client(v, F.lit(None).cast("string"))) == ["Govt OF West Bengal"]
    assert results(spark, ["Public Works Dept,"], lambda v: names.letterhead_client(v, F.lit("Zone"))) == ["Public Works Dept, Zone"]
    assert results(spark, ["Certificate of work"], lambda v: names.letterhead_client(v, F.lit(None).cast("string"))) == [None]
    assert results(spark, ["DOC-CC-021"], names.package_from_id) == ["Pkg-21"]
    assert results(spark, ["Road — north", "Bridge-2"], names.category_before_dash) == ["Road", "Bridge"]


def test_texts_without_short_forms_are_not_searched_for_each(spark):
    import re

    texts = ["Govt. of U.P.x, PWD-pw!", "up the coast", "UP u.p.mp m p", "nothing at all, Upper coast", "Ünder  co\u00a0é", "", None]
    want = []
    for t in texts:
        t = (t or "").lower()
        for short, long in (*names.ABBREVIATIONS.items(), *names.STATES.items()):
            t = re.sub(rf"\b{re.escape(short)}\b", long, t, flags=re.ASCII)
        want.append(re.sub(r"^[ \t\n]+|[ \t\n]+$", "", re.sub(r"[ \t\n]+", " ", re.sub(r"[^\w\s]", " ", t))))
    assert results(spark, texts, names.normalize_mention) == want
    assert "CASE WHEN" in str(names.normalize_mention(F.col("t")))


def test_fields_of_a_text(spark):
    doc = "|Client|PWD|\n|---|---|\n**Client:** Roads Board\nClient: third\nDate: 2021-01-02\nManager\nA. Person"
    kv = text.with_key_values(spark.createDataFrame([(doc,), (None,)], "text string")).collect()
    assert kv[0]["kv"]["client"] == "Roads Board" and kv[0]["kv"]["date"] == "2021-01-02" and kv[0]["kv"]["manager"] == "A. Person"
    assert not kv[1]["kv"]
    assert results(spark, [doc], lambda v: text.line_before(v, "a. person")) == ["Manager"]
    assert results(spark, [" a \n\n\t b\n"], basic.lines) == [["a", "b"]]


def test_a_condition_on_a_map_of_labels_does_not_read_the_text_again_for_each_label(spark):
    rows = spark.createDataFrame([(1, "|Client|PWD|\n**Value:** INR 5 Cr\nDate: 2021\nnote\nlast")], "i int, text string")
    rows = text.with_key_values(rows).select("i", F.explode("kv").alias("k", "v"))
    assert {(r["k"], r["v"]) for r in rows.collect()} >= {("client", "PWD"), ("value", "INR 5 Cr"), ("date", "2021"), ("note", "last")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3 * 6  # once for the map, twice for the conditions that Spark adds


def test_typed_records(spark):
    docs = [
        ("D1", "completion_certificate", "Roads Authority\nThis is to certify that the work of 'Bridge Pkg-7', awarded to X for INR 12.5 Cr, was completed on 2020-05-06. It was supervised by Asha Rao. The work was graded Good by us."),
        ("D2", "reference_letter", "Ref: 1\nWater Board\nSubject: 'WTP Pkg-3'\nValue: Rs. 2 lakh\ncompleted on 5/6/2020"),
        ("D3", "performance_bond", "**Guarantee amount:** INR 5 lakh\nABC Bank\nwork of 'Dam Pkg-9'.\nuntil **2024-01-01**"),
        ("D4", "personnel_certificate", "Employee Name: B. Iyer\nEmployee ID: EMP-12\nPMP\nIssued: 2021-03-10"),
        ("D5", "cv", "Name: C. Das\nDesignation: Lead\n|1|Road A|Pkg-1|PWD|Lead|"),
        ("D6", "ra_bill", "Contract #4 · Port Trust\nBill No: 7\n|1|Earth|m3|10|5|50|\nRs. 900"),
    ]
    rows = spark.createDataFrame(docs, "doc_id string, doc_type string, text string")
    one = {k: f(rows).collect()[0] for k, f in extract.LABELLED.items()}
    c = one["certificates"]
    assert (c["project_name"], c["package_code"], c["client_name"], c["contract_value"], c["completion_date"], c["project_lead"]) == ("Bridge Pkg-7", "Pkg-7", "Roads Authority", 1.25e8, "2020-05-06", "Asha Rao")
    assert c["grading_text"] == "The work was graded Good by us."
    assert (one["reference_letters"]["issuing_client"], one["reference_letters"]["contract_value"]) == ("Water Board", 200000.0)
    assert (one["performance_bonds"]["guarantee_amount"], one["performance_bonds"]["issuing_bank"], one["performance_bonds"]["expiry_date"]) == (500000.0, "ABC Bank", "2024-01-01")
    assert (one["personnel_certificates"]["engineer_name"], one["personnel_certificates"]["employee_id"], one["personnel_certificates"]["certification_type"]) == ("B. Iyer", "EMP-12", "PMP")
    assert one["cvs"]["projects_led"][0]["package_code"] == "Pkg-1"
    assert one["bills"]["client_name"] == "Port Trust" and one["bills"]["boq_items"][0]["amount"] == 50.0 and one["bills"]["billed_value"] == 900.0


def test_records_by_lines(spark):
    docs = [
        ("C1", "completion_certificate", "Water Board of\nNorth Zone\nName of Work\nNature of things\nParticulars of the work\nTank Pkg-12 (phase 2)\nNature / Category\nwater treatment\nContract Value\nnone\nExecuted Value\nRs. 3 Cr\nActual completion date\n5-Mar-2020\nContractor's Manager\nNational Infra\nThe overall quality of the completed work is graded Good.\nAsha Rao\nProject Manager\nNational Infra Ltd"),
        ("C2", "company_completion_certificate", "Ref: No. 7\nThe work of \u201cRoad Pkg-3 (large bridges)\u201d with an executed value of INR 2 lakh (two) was completed in all respects on 12 May 2021, supervised on the contractor's side by Bela Iyer. INR 9"),
        ("C3", "completion_certificate", None), ("C4", "completion_certificate", ""),
        ("L1", "reference_letter", "Port Trust\nfor the work \u201cQuay Package 8\u201d (INR 4 Cr) done on 2019-01-31"), ("L2", "reference_letter", "Port Trust\nWork\nMole"),
        ("B1", "performance_bond", "a sum of Rs. 7 lakh, later Rs. 8 lakh"),
        ("P1", "personnel_certificate", "This is to certify that\n\nC. Das\nEmployee ID: EMP-9\nproject management professional: Project Management Professional\nLicense No: X-1\nDate of Issue: March 10, 2021\nValid Through: 2024-03-10"), ("P2", "personnel_certificate", "awarded to Dev Sen, Six Sigma"),
        ("V1", "cv", "CURRICULUM VITAE\nE. Fox\nDesignation: Lead\nid EMP-77\nProject: Road A \u00b7 Pkg-1\nWork:  Dam  \u00b7 Pkg-x2"), ("V2", "cv", "G. Hall\nno label"), ("V3", "cv", None),
    ]
    rows = spark.createDataFrame(docs, "doc_id string, doc_type string, text string")
    got = {k: {r["doc_id"]: r for r in f(rows).collect()} for k, f in extract.BY_LINE.items() if k != "cv_projects"}
    day = lambda *a: datetime.date(*a)
    c = got["certificates"]
    assert tuple(c["C1"])[2:] == ("Tank Pkg-12", "Pkg-12", "Water Board of North Zone", "water treatment", 30_000_000.0, day(2020, 3, 5), "Asha Rao", "Good")
    assert tuple(c["C2"])[2:] == ("Road Pkg-3", "Pkg-3", None, "large bridges", 200_000.0, day(2021, 5, 12), "Bela Iyer", None)
    assert set(tuple(c["C3"])[2:]) == set(tuple(c["C4"])[2:]) == {None}
    assert tuple(got["reference_letters"]["L1"])[1:] == ("Quay Package 8", "Pkg-8", "Port Trust", 40_000_000.0, day(2019, 1, 31)) and got["reference_letters"]["L2"]["project_name"] == "Mole"
    assert got["performance_bonds"]["B1"]["guarantee_amount"] == 700_000.0
    assert tuple(got["personnel_certificates"]["P1"])[2:] == ("EMP-9", "PMP", "X-1", day(2021, 3, 10), day(2024, 3, 10)) and got["personnel_certificates"]["P2"]["certification_type"] == "Six Sigma Black Belt"
    assert tuple(got["cvs"]["V1"])[1:] == ("E. Fox", "EMP-77", "Lead") and got["cvs"]["V2"]["engineer_name"] == "G. Hall" and got["cvs"]["V3"]["engineer_name"] is None
    assert {tuple(r) for r in extract.line_cv_projects(rows).collect()} == {("V1", "E. Fox", "Road A", "Pkg-1"), ("V1", "E. Fox", "Dam", "Pkg-x2")}


def test_column_letters(spark):
    assert results(spark, [0, 25, 26, 701, 702, 16383], column_letter, "int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_sql_money_works_each_step_out_once(spark):
    from sheafline.functions.sql import register

    register(spark)
    rows = spark.createDataFrame([("Rs. 10.13 Cr /-",), ("5 lakhs",), ("7",), ("-1e3",), ("2,500 k",), ("x",), ("",), (None,)], "t string")
    rows.createOrReplaceTempView("amounts_as_text")
    got = spark.sql("SELECT t, parse_money(t) AS v FROM amounts_as_text")
    assert {r["t"]: r["v"] for r in got.collect()} == {r["t"]: r["v"] for r in rows.select("t", money.parse_money(F.col("t")).alias("v")).collect()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 12
