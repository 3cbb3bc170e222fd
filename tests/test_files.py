"""Sources, sinks, commands, streams and the entry module."""

import datetime
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheafline import __main__ as command
from sheafline import sinks, sources, streaming
from sheafline.plans import orchestrate

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def files(tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"qid": "a", "question": "x", "answer_type": "money", "answer": 100.0, "shape": "s", "hops": 1}, {"qid": "b", "question": "y", "answer_type": "percent", "answer": 50.0}, {"question_id": "c", "answer_type": "count", "answer_gold": 2, "scored": False}]}))
    (tmp_path / "a.csv").write_text("question_id,answer\na,\"1,00\"\nb,50\nc,2\n")
    (tmp_path / "b.csv").write_text("a,90\nb,0.5\n")
    (tmp_path / "a.jsonl").write_text('{"qid": "a", "answer": 95}\n{"qid": "a", "answer": 96}\n')
    return tmp_path


def test_questions_in_all_forms(spark, files):
    got = {r["qid"]: (r["gold"], r["scored"]) for r in sources.questions(spark, str(files / "q.json")).collect()}
    assert got == {"a": (100.0, True), "b": (50.0, True), "c": (2.0, False)}
    (files / "bare.json").write_text('[{"qid": "z", "answer": 1}]')
    assert [r["qid"] for r in sources.questions(spark, str(files / "bare.json")).collect()] == ["z"]
    (files / "under.json").write_text('{"answers": [{"qid": "y", "answer": 1}]}')
    assert [r["qid"] for r in sources.questions(spark, str(files / "under.json")).collect()] == ["y"]


def test_answers_in_all_forms(spark, files):
    assert {(r["qid"], r["raw_answer"]) for r in sources.submission(spark, str(files / "a.csv")).collect()} == {("a", "1,00"), ("b", "50"), ("c", "2")}
    assert {(r["qid"], r["raw_answer"]) for r in sources.submission(spark, str(files / "b.csv")).collect()} == {("a", "90"), ("b", "0.5")}
    assert [r["raw_answer"] for r in sources.answer_lines(spark, str(files / "a.jsonl")).orderBy("row_num").collect()] == ["95", "96"]


def test_envelopes_and_payloads(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"doc_id": "D1", "doc_type": "cv", "extracted_data": {"engineer_name": "A", "projects_led": [{"project_name": "P"}]}}, indent=1))
    (tmp_path / "2.json").write_text("{broken")
    (tmp_path / "3.json").write_text(json.dumps({"doc_id": "D3", "doc_type": "other", "extracted_data": {"key_values": {"k\n1": "v"}, "money_mentions": [["INR 5", "5"]]}}))
    rows = sources.envelopes(spark, str(tmp_path / "*.json"))
    assert {r["doc_id"] for r in rows.collect()} == {"D1", "D3"}
    assert sources.payload(rows, "cv").collect()[0]["projects_led"][0]["project_name"] == "P"
    assert sources.payload(rows, "other").collect()[0]["key_values"] == {"k\n1": "v"}
    index = spark.createDataFrame([("D1", "cv", "x", 1), ("D2", "cv", "y", 1)], sources.INDEX)
    c = orchestrate.ExtractedDocuments(rows, index).coverage().collect()[0]
    assert (c["total"], c["extracted"], c["missing"], c["pct"]) == (2, 1, 1, 50.0)


def test_walk_and_texts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("sub/DOC-CV-1.pdf", "~$lock.xlsx", "ageing.xlsx", "note.txt"):
        (tmp_path / name).write_text("x")
    assert {(r["doc_id"], r["doc_type"]) for r in sources.walk(spark, str(tmp_path)).collect()} == {("DOC-CV-1", "cv"), ("ageing", "workbook")}
    (tmp_path / "note.txt").write_text("page one\fpage two")
    r = sources.texts(spark, str(tmp_path / "note.txt")).collect()[0]
    assert (r["doc_id"], r["text"], r["page_count"], r["warning"]) == ("note", "page one\n\npage two", 2, None)


def test_log_and_sheets(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"doc_id": "a", "status": "ok"}\n\nbad\n')
    assert sorted((r["doc_id"] or "", r["bad"]) for r in sources.log(spark, str(tmp_path / "log.jsonl")).collect()) == [("", True), ("a", False)]
    sheets = spark.createDataFrame([("d", "s", [["1", None]], [["1", "=A1"]])], "doc_id string, sheet string, values array<array<string>>, formulas array<array<string>>")
    assert [(r["column"], r["value"]) for r in sources.sheet_rows(sheets).orderBy("column").collect()] == [("A", "1"), ("B", "=A1")]
    money = sources.receivables(spark.createDataFrame([("c", 5.0, None), ("c", 2.5, 1.0)], "client_name string, invoiced double, received double")).collect()[0]
    assert (float(money["invoiced"]), float(money["received"])) == (7.5, 1.0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.345), ("a", 5.0)], "qid string, answer double")
    sinks.answers_csv(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).orderBy("question_id").collect()] == [("a", "5"), ("b", "2.35")]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    assert {tuple(r) for r in sinks.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "doc_id string, v int")).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    found = sinks.manifest(spark, str(tmp_path / "out"), True)
    assert found["rows"] == 2 and len(found["files"][0]["sha256"]) == 64 and json.loads(sinks.manifest_json(found))
    assert "| a | 5.00 |" in sinks.markdown("T", {"s": rows.orderBy("qid")})


def test_commands(spark, files, capsys):
    q, a, b = (str(files / n) for n in ("q.json", "a.csv", "b.csv"))
    assert command.main(["validate", q, a], spark) == 0 and command.main(["validate", q, b], spark) == 1
    assert command.main(["score", q, a], spark) == 0 and "| 2.00 | 2 | 1.00 |" in capsys.readouterr().out
    assert command.main(["compare", b, a, "--gold", q], spark) == 0 and "IMPROVED" in capsys.readouterr().out
    assert command.main(["export", q, b, str(files / "fixed")], spark) == 0
    assert {r["question_id"]: r["answer"] for r in spark.read.csv(str(files / "fixed"), header=True).collect()} == {"a": "90", "b": "50", "c": "2"}
    assert command.main(["history", q, a, str(files / "history")], spark) == 0 and spark.read.json(str(files / "history")).count() == 1


def test_orchestration_solves_what_is_not_kept(spark):
    class Fixed:
        def solve(self, questions):
            return questions.select("qid", F.lit(7.0).alias("answer"))

    q = spark.createDataFrame([("a", "x", "money", 7.0), ("b", "y", "count", 2.0)], "qid string, question string, answer_type string, gold double")
    out = orchestrate.run(q, Fixed(), spark.createDataFrame([("b", 2.0)], "qid string, answer double"))
    assert {tuple(r) for r in out["answers"].collect()} == {("a", 7.0), ("b", 2.0)}
    assert out["summary"].collect()[0]["is_valid"] and {r["bucket"]: r["count"] for r in out["histogram"].collect()}["exact"] == 2
    lists = spark.createDataFrame([("a", "t", ["X", "Y"]), ("b", "t", ["Z"])], "qid string, text string, shortlist array<string>")
    assert [tuple(r) for r in orchestrate.outside_choices(lists, lambda text, names: "Y").collect()] == [("a", "Y")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, datetime.datetime(2024, 1, 1, 0, 0)), ("a", 2.0, datetime.datetime(2024, 1, 1, 0, 5)), ("b", 3.0, datetime.datetime(2024, 1, 1, 0, 9))], "qid string, value double, ts timestamp")
    counts = streaming.windowed_counts(rows, "10 minutes", "1 hour").collect()
    assert [(r["n"], r["total"]) for r in counts] == [(3, 6.0)]


def test_the_last_answer_of_a_stream_stands(spark, tmp_path):
    """Answers come in three files, out of order, with ties, nulls and repeated rows; each file is a batch."""
    from sheafline.operators.works import last_write_wins

    path, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    schema = "qid string, answer double, row_num int"
    parts = [[("a", 1.0, 5), ("b", 2.0, 1), (None, 9.0, 1)], [("a", 7.0, 2), ("b", 3.0, 4), ("b", 3.0, 4)], [("a", 8.0, 9), ("c", None, 1), (None, 4.0, 3)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        streaming.append_log(streaming.latest_answers(stream), log, checkpoint, mode="update", once=True).awaitTermination()
    answers = streaming.read_log(spark, log, "qid string, row_num int, answer double, duplicated boolean")
    assert {r["_batch"] for r in answers.collect()} == {0, 1, 2}
    want = {tuple(r) for r in last_write_wins(spark.read.schema(schema).parquet(path)).select("qid", "row_num", "answer", "duplicated").collect()}
    got = [tuple(r) for r in streaming.latest_of_log(answers).select("qid", "row_num", "answer", "duplicated").collect()]
    assert len(got) == 4 and set(got) == want
    # a batch that is written again changes nothing
    before = sorted(map(str, answers.collect()))
    streaming.write_batch(spark.createDataFrame([tuple(r)[:4] for r in answers.where("_batch = 1").collect()], "qid string, row_num int, answer double, duplicated boolean"), 1, log)
    assert sorted(map(str, streaming.read_log(spark, log, "qid string, row_num int, answer double, duplicated boolean").collect())) == before


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_entry_works_without_the_optional_parts(tmp_path, gone):
    """A copy of the library without the subpackage, and with or without the pipeline, imports and lists its other queries."""
    copy = f"""
import shutil, sys
shutil.copytree({str(ROOT)!r}, {str(tmp_path / "r")!r}, ignore=shutil.ignore_patterns(*{gone!r}, ".git", "tests", "spark-warehouse", "__pycache__"))
sys.path.insert(0, {str(tmp_path / "r")!r})
import __spark_entry__ as e
names = e.queries()
assert e.__file__.startswith({str(tmp_path)!r}) and len(names) > 50 and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", copy], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH")})


def workbook_file(path, sheets: dict[str, str], strings: list[str] | None = None) -> None:
    """A workbook of hand-written XML: title to rows."""
    import zipfile
    from xml.sax.saxutils import quoteattr

    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p">' + "".join(f'<Relationship Id="rId{i}" Type="t" Target="/xl/worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="m"><dimension ref="A1"/><sheetData>{rows}</sheetData></worksheet>')
        if strings is not None:
            book.writestr("xl/sharedStrings.xml", '<sst xmlns="m">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        book.writestr("docProps/app.xml", "<x/>")


def test_workbooks(spark, tmp_path):
    from pyspark.sql import functions as F

    from sheafline.sources import workbook

    rows = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row r="3"><c r="A3"><v>2.0</v></c><c r="B3"><f>A3*2</f><v>4</v></c><c r="C3"><f t="shared" si="0">A3+1</f></c><c r="XFD3" t="b"><v>1</v></c></row><row r="4"><c r="A4" s="1"/></row>'
    workbook_file(tmp_path / "a.xlsx", {"AR Ageing": rows, "Empty & all": "", "No refs": '<row><c t="inlineStr"><is><t> x </t></is></c><c t="str"><v>y</v></c></row><row><c><v>1.5</v></c></row>'}, ["<t>plain</t>", '<r><t xml:space="preserve">rich </t></r><r><t>text</t></r>'])
    (tmp_path / "bad.xlsx").write_bytes(b"no container")
    parts = workbook.entries(spark, str(tmp_path))
    assert [(r["doc_id"], r["warning"] is not None) for r in parts.where("name is null").collect()] == [("bad", True)]
    found = workbook.cells(parts)
    got = {(r["sheet"], r["column"], r["row_no"]): (r["value"], r["formula"]) for r in found.collect()}
    assert got == {
        ("AR Ageing", "A", 1): ("rich text", None), ("AR Ageing", "C", 1): ("plain", None), ("AR Ageing", "A", 3): ("2", None), ("AR Ageing", "B", 3): ("4", "A3*2"), ("AR Ageing", "C", 3): (None, "A3+1"),
        ("AR Ageing", "XFD", 3): ("TRUE", None), ("No refs", "A", 1): (" x ", None), ("No refs", "B", 1): ("y", None), ("No refs", "A", 2): ("1.5", None),
    }
    assert [tuple(r) for r in workbook.unresolved(found).collect()] == [("a", "Unresolved formula cell at 'AR Ageing'!C3")]
    sheets = {r["sheet"]: r for r in workbook.tables(found, most=2).collect()}
    assert sheets["No refs"]["headers"] == [" x ", "y"] and sheets["No refs"]["rows"] == [[" x ", "y"], ["1.5", None]]
    aged = sheets["AR Ageing"]
    assert aged["row_count"] == 3 and aged["headers"][:4] == ["rich text", "col_1", "plain", "col_3"] and len(aged["rows"]) == 2 and set(aged["rows"][1]) == {None}
    letters = spark.range(1, 20_000, 7).select("id", workbook.column_letters(F.col("id")).alias("l"))
    assert letters.where(workbook.column_number(letters["l"]) != letters["id"]).count() == 0
    assert workbook.cells(parts.where("false")).count() == 0


def csv_pieces(text, size, file="f"):
    return [(file, at // (3 * size), at, text[at : at + size]) for at in range(0, len(text), size)]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_csv_is_read_however_it_is_cut(spark, size):
    import csv
    import io
    import random

    from sheafline.sources import csv_text

    random.seed(size)
    rows = [["".join(random.choice(['"', ",", "\n", "a", "\r\n", " ", "\u0001", "\u0003", "é"]) for _ in range(random.randint(0, 6))) for _ in range(random.randint(1, 5))] for _ in range(60)]
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows(rows)
    text = out.getvalue()
    made = csv_pieces(text, size) + csv_pieces("x,1\n\n,\ny", size, "g") + [("h", 0, 0, None)]
    pieces = spark.createDataFrame(made, "file string, chunk int, at int, text string").repartition(5)
    found = csv_text.records(pieces)
    got = found.select("file", "row_num", csv_text.cells(found["record"]).alias("x")).orderBy("file", "row_num").collect()
    assert [(r["row_num"], r["x"]) for r in got if r["file"] == "f"] == list(enumerate(rows))
    assert [(r["row_num"], r["x"]) for r in got if r["file"] == "g"] == [(0, ["x", "1"]), (1, [""]), (2, ["", ""]), (3, ["y"])]
    assert [r for r in got if r["file"] == "h"] == [] and csv_text.records(pieces.where("false")).count() == 0


def test_submissions_with_line_ends_in_cells(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Note, QID ,x,y,ANSWER\n"a\nb",q1,,,"1\n2"\n\nshort,q2\n"c",q3,,,5\nd,,,,9\n')
    got = [(r["qid"], r["raw_answer"], r["row_num"]) for r in sources.submission(spark, str(tmp_path / "n.csv")).orderBy("row_num").collect()]
    assert got == [("q1", "1\n2", 1), ("q3", "5", 4)]
    (tmp_path / "e.csv").write_text("")
    assert sources.submission(spark, str(tmp_path / "e.csv")).count() == 0
