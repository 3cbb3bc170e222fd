"""The entity graph, its components and questions in words, with nulls, ties, repeated rows and empty tables."""

import datetime
import random
import time

from pyspark.sql import functions as F

from sheafline import sinks
from sheafline.operators import graph, lineage, resolve
from sheafline.plans import ask

D = datetime.date
CERTS = "doc_id string, client_name string, package_code string, project_name string, category string, contract_value double, completion_date date, project_lead string"


def certs(spark):
    rows = [
        ("C1", "Roads Dept (PSU)", "Pkg-1", "Road", "roads", 100.0, D(2022, 1, 1), "Asha Rao"),
        ("C2", "Roads Department", "package 1", "Road north", None, 0.0, None, None),
        ("C2", "Roads Department", "package 1", "Road north", None, 0.0, None, None),
        ("C3", "Port Trust", None, "Quay Pkg-3", "ports", 50.0, D(2021, 6, 1), "asha rao"),
        ("DOC-4", None, None, None, None, None, None, None),
        (None, "Nobody", None, None, None, 5.0, None, None),
        ("C6", "National Infrastructure Corp office", "Pkg-X", "One letter", None, 1.0, None, "B. Iyer"),
    ]
    return spark.createDataFrame(rows, CERTS)


def others(spark, empty=False):
    keep = lambda rows: [] if empty else rows
    return {
        "letters": spark.createDataFrame(keep([("L1", "Pkg-1", "Long long name of a road", "Harbour Board", 900.0, D(2020, 1, 1)), ("L2", "Pkg-9", None, "Harbour Board", 70.0, D(2019, 1, 1))]), "doc_id string, package_code string, project_name string, issuing_client string, contract_value double, completion_date date"),
        "bonds": spark.createDataFrame(keep([("BOND-0012", None, None, "Port Trust", D(2018, 1, 1), D(2018, 6, 1)), ("B9", "Pkg-9", None, None, D(2017, 1, 1), D(2017, 2, 1))]), "doc_id string, package_code string, project_name string, beneficiary string, issue_date date, expiry_date date"),
        "bills": spark.createDataFrame(keep([("R-3", None, None, "Harbour Board"), ("R-8", "Pkg-88", None, "X"), ("R-9", "Pkg-9", None, "Port Trust")]), "doc_id string, package_code string, project_name string, client_name string"),
        "personnel": spark.createDataFrame(keep([("P1", "Asha Rao", "E1", "PMP", "x", D(2020, 1, 1), None), ("P1", "Asha Rao", "E1", "PMP", "x", D(2020, 1, 1), None), ("P2", None, "E2", "PMP", "y", None, None)]), "doc_id string, engineer_name string, employee_id string, certification_type string, credential_id string, issue_date date, expiry_date date"),
        "cvs": spark.createDataFrame(keep([("V1", "C. Das", None, [("Quay Pkg-3", None), (None, None)]), ("V2", "asha rao", "E7", None)]), "doc_id string, engineer_name string, employee_id string, projects_led array<struct<project_name: string, package_code: string>>"),
    }


def test_the_graph_of_a_small_archive(spark, tmp_path):
    g = graph.entity_graph(certs(spark), **others(spark))
    projects = {r["package"]: r for r in g.projects.collect()}
    assert set(projects) == {"Pkg-1", "Pkg-3", "Pkg-4", "Pkg-9", "Pkg-12", "Pkg-6"}
    one = projects["Pkg-1"]
    assert (one["project_name"], float(one["contract_value"]), one["completion_date"], one["documents"]) == ("Road north", 100.0, "2022-01-01", ["C1", "C2", "L1"]) and one["has_letter"]
    # without a certificate the first record by doc_id makes the project: the bond B9, not the letter L2
    nine = projects["Pkg-9"]
    assert (nine["project_name"], nine["contract_value"], nine["start_date"], nine["completion_date"], nine["bills"]) == ("Pkg-9", None, "2017-01-01", "2017-02-01", ["R-9"])
    assert projects["Pkg-4"]["client_id"] is None and projects["Pkg-12"]["has_bond"]
    clients = {r["key"]: r for r in g.clients.collect()}
    assert set(clients) == {"roads department", "port trust", "harbour board"} and clients["roads department"]["variants"] == ["Roads Department", "Roads Dept (PSU)"]
    # Roads and Harbour share Pkg-1, Harbour and Port share Pkg-9
    assert {r["component"] for r in clients.values()} == {"CLIENT-001"}
    people = {r["key"]: r for r in g.engineers.collect()}
    assert set(people) == {"asha rao", "b. iyer", "c. das"} and people["asha rao"]["employee_id"] == "E1" and len(people["asha rao"]["certifications"]) == 1 and people["asha rao"]["n_led"] == 2
    documents = {r["doc_id"]: (r["resolved"], r["resolved_package"]) for r in g.documents.collect()}
    assert documents["R-3"] == (False, None) and documents["R-8"] == (False, None) and documents["R-9"] == (True, "Pkg-9") and documents[None] == (True, None) and documents["V1"] == (True, None)
    assert {(r["doc_id"], r["raw"], r["normalized"]) for r in g.normalizations.collect()} == {("C2", "package 1", "Pkg-1")}
    counts = g.metadata.first()
    assert (counts["total_projects"], counts["total_clients"], counts["total_engineers"], counts["total_documents"]) == (6, 3, 3, len(documents))
    edges = {tuple(r) for r in g.edges.collect()}
    assert ("lead", "c. das", "Pkg-3") in edges and ("client", "Pkg-1", clients["harbour board"]["client_id"]) in edges and ("document", "Pkg-9", "R-9") in edges
    path = str(tmp_path / "graph")
    sinks.graph(g, path)
    assert spark.read.json(path + "/projects").count() == 6 and spark.read.json(path + "/edges").where("kind = 'document'").count() == len([e for e in edges if e[0] == "document"])


def test_an_empty_archive_has_an_empty_graph(spark):
    g = graph.entity_graph(certs(spark).where("false"), **others(spark, empty=True))
    assert [getattr(g, name).count() for name in ("projects", "clients", "engineers", "documents", "edges", "normalizations", "review")] == [0] * 7
    assert tuple(g.metadata.first()) == (0, 0, 0, 0)


def test_names_with_like_words_are_kept_for_review(spark):
    rows = spark.createDataFrame([("C1", "North Road Board", "Pkg-1", None, None, 1.0, None, None), ("C2", "Road Board, South", "Pkg-2", None, None, 1.0, None, None), ("C3", "Ports", "Pkg-3", None, None, 1.0, None, None)], CERTS)
    found = graph.entity_graph(rows, **others(spark, empty=True)).review.collect()
    assert [(r["candidate_1"], r["candidate_2"], r["shared"], r["status"]) for r in found] == [("North Road Board", "Road Board, South", 2, "kept_separate_pending_review")]


def test_components_are_those_of_a_plain_search(spark):
    random.seed(4)
    links = [(random.randint(0, 90), random.randint(0, 90)) for _ in range(60)]
    links += [(200 + i, 201 + i) for i in range(70)]  # a long chain
    links += [(300, i) for i in range(301, 400)] + [(500, 500), (None, 3), (4, None), links[0], links[0]]
    least = {n: n for a, b in links if a is not None and b is not None for n in (a, b)}
    for _ in least:
        for a, b in links:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = [tuple(r) for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()]
    assert len(got) == len(least) and dict(got) == least
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_questions_name_their_clients(spark):
    rows = certs(spark)
    letters = spark.createDataFrame([("Pkg-1", "Roads Department", None)], "package_code string, issuing_client string, contract_value double")
    money = spark.createDataFrame([("Port Trust", 40.0, 10.0)], "client_name string, invoiced double, received double")
    people = spark.createDataFrame([("P1", "Asha Rao", D(2021, 12, 1))], "doc_id string, engineer_name string, issue_date date")
    asked = [
        ("1", "Total value of all completed assignments of the Port Trust?", "money"), ("2", "What has been billed for Pkg-1?", "percent"), ("3", "What was invoiced to Port Trust?", "percent"),
        ("4", "Value of what Asha Rao saw completed after her PMP?", "money"), ("5", None, "count"), ("6", "How many days for Pkg-1?", "days"), ("7", "Days until the quay was ready?", "days"), ("8", "nothing known", None),
    ]
    questions = spark.createDataFrame(asked, "qid string, question string, answer_type string")
    got = {r["qid"]: (r["client"], r["engineer"], r["shape"], r["answer"]) for r in ask.answer(questions, rows, letters, money, people).collect()}
    assert got["1"] == ("Port Trust", None, "hop_aggregate", 50.0)
    assert got["2"][2:] == ("fallback", 50.0) and got["3"] == ("Port Trust", None, "collection_pct", 25.0)
    assert got["4"][1:] == ("Asha Rao", "temporal_chain", 100.0) and got["5"] == (None, None, "fallback", 1.0)
    assert got["6"][2:] == ("date_span", 297.0) and got["7"][2:] == ("date_span", 83.0) and got["8"][2:] == ("fallback", 0.0)
    assert ask.answer(questions.where("false"), rows, letters, money, people).count() == 0


def test_later_layers_get_only_what_is_left(spark, monkeypatch):
    names = spark.createDataFrame([("Port Trust",), ("Roads Department",)], "entity string")
    seen = []
    real = resolve.fuzzy
    monkeypatch.setattr(resolve, "fuzzy", lambda left, entities: seen.append(sorted(r["qid"] for r in left.collect())) or real(left, entities))
    said = spark.createDataFrame([("1", "the Port Trust"), ("2", "road departmnt"), ("2", "road departmnt")], "qid string, text string")
    got = {(r["qid"], r["entity"], r["layer"]) for r in resolve.resolve(said, names).collect()}
    assert ("1", "Port Trust", 1) in got and seen == [["2", "2"]]
    seen.clear()
    resolve.resolve(said.where("qid = '1'"), names)
    assert seen == []


def test_bands_find_what_a_full_comparison_finds(spark):
    import decimal

    from sheafline.operators import works

    random.seed(6)
    value = lambda: decimal.Decimal(random.choice([random.randint(-400_000, 400_000), random.randint(0, 60) * 10_000, -10_000, 0])) / 100
    rows = [(i, random.choice(["a", "b", None]), random.choice([value(), None])) for i in range(250)] + [(900 + i, "hot", decimal.Decimal(i * 1000)) for i in range(300)]
    table = spark.createDataFrame(rows, "id int, k string, v decimal(18,2)").repartition(3)
    want = {i for i, k, v in rows if k is not None and v is not None and any(j != i and k == q and w is not None and abs(v - w) < 1000 for j, q, w in rows)}
    got = [r["id"] for r in works.close_to_another(table, ["k"], "v", 1000).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert works.close_to_another(table.where("false"), ["k"], "v", 1000).count() == 0
    letters = [(None, "A" if k == "a" else k, v) for _, k, v in rows[:60]]
    made = table.select(F.col("id").cast("string").alias("doc_id"), F.col("k").alias("client_name"), F.lit(None).cast("string").alias("package_code"), F.col("v").alias("contract_value"))
    flags = {r["doc_id"]: r["referenced"] for r in works.referenced(made, spark.createDataFrame(letters, "package_code string, issuing_client string, contract_value decimal(18,2)")).collect()}
    assert flags == {str(i): bool(k and v and any(q and q.lower() == k and w is not None and abs(v - w) < 1000 for _, q, w in letters)) for i, k, v in rows}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(f"d{i}", i, "old") for i in range(200)] + [("d1", 1, "twin"), (None, -1, "old")]
    sinks.create_table(spark.createDataFrame(old, "doc_id string, n int, origin string"), path, buckets=32)
    read = lambda: {r["doc_id"]: (r["n"], r["origin"]) for r in spark.read.schema("doc_id string, n int, origin string, _bucket int").parquet(path).collect()}
    first = read()
    assert len(first) == 201
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("d5", 1, "new"), ("d5", 3, "newer"), ("x", 0, "new"), (None, 9, "new")], "doc_id string, n int, origin string")
    touched = sinks.upsert_into(path, new, order="n", buckets=32)
    assert 1 <= len(touched) <= 3 and read() == first | {"d5": (3, "newer"), "x": (0, "new"), None: (9, "new")}
    after = files()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.parent.name.split("=")[1]) not in touched}
    assert sinks.upsert_into(path, new, order="n", buckets=32) == touched and read()["d5"] == (3, "newer")  # repeated, it changes nothing
    assert sinks.upsert_into(path, new.where("false"), buckets=32) == []


def test_objects_of_any_shape_become_plain_json(spark):
    import json

    from sheafline.functions import objects

    texts = ['{"b": [1, {"c": null, "a": "x\\"y"}, []], "a": {}}', "[]", '"é\\n"', "1.50", "true", "null", '{"t": [3, 1, 3, "z"], "u": {"t": [{"q": 2}, {"q": 1}, {"q": 2}]}}', None]
    rows = spark.createDataFrame([(i % 7 if i else None, t) for i, t in enumerate(texts)], "k int, t string").select("k", F.parse_json("t").alias("v"))
    got = sorted(r["json"] for r in objects.clean_json(rows, "k", "v", sets=("t",)).collect())
    want = ['{"a":{},"b":[1,{"a":"x\\"y","c":null},[]]}', "[]", '"é\\n"', "1.5", "true", "null", '{"t":["z",1,3],"u":{"t":[{"q":1},{"q":2}]}}', "null"]
    assert got == sorted(want) and [json.loads(t) for t in got]
    typed = spark.sql("SELECT 1 AS k, to_variant_object(named_struct('d', DATE'2020-02-03', 'n', double('NaN'), 'i', float('-Infinity'), 't', TIMESTAMP'2020-02-03 04:05:06.7', 'm', map('x', 1.25BD))) AS v")
    assert objects.clean_json(typed, "k", "v").first()["json"] == '{"d":"2020-02-03","i":null,"m":{"x":1.25},"n":null,"t":"2020-02-03T04:05:06.700000"}'
    assert objects.clean_json(rows.where("false"), "k", "v").count() == 0


def test_objects_are_cleaned_within_their_rows_unless_they_are_very_deep(spark, monkeypatch):
    import json

    from sheafline.functions import objects

    monkeypatch.setattr(objects, "LEVELS", 2)
    texts = ['{"t":["x"]}', '{"t":[{"t":["x"]}]}', "[[[1]]]", "[[]]", "[[{}]]", '{"t":[2,1,2]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.parse_json("t").alias("v"))
    got = {r["k"]: r["json"] for r in objects.clean_json(rows, "k", "v", sets=("t",)).collect()}
    assert got == {i: t.replace("[2,1,2]", "[1,2]") for i, t in enumerate(texts)} and all(json.loads(t) for t in got.values())
    flat = objects.clean_json(rows.where("k in (0, 3, 5)"), "k", "v", sets=("t",))
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()


def test_sql_text_can_use_the_functions(spark):
    from sheafline.functions import text as T
    from sheafline.functions.sql import register

    register(spark)
    row = spark.sql("SELECT parse_money('INR 1.5 Cr') AS a, parse_money(NULL) AS b, score_one(10, 9) AS c, score_one(0, NULL) AS d, normalize_mention('PWD, UP') AS e, money_mentions('Rs 5 and 2 lakh') AS f").first()
    assert row[:5] == (15_000_000.0, None, 0.9, 0.0, "public works department uttar pradesh") and [tuple(m) for m in row["f"]] == [("Rs 5", 5.0), ("2 lakh", 200_000.0)]
    said = "|Client|Port Trust|\n|---|---|\n**Value:** 5 Cr\nDate: 2021-01-02\nIssued\n 3 May \n\nend: "
    spark.createDataFrame([(said,), (None,), ("",)], "t string").createOrReplaceTempView("said")
    got = {(r["kind"], r["label"], r["value"]) for r in spark.sql("SELECT p.* FROM said, LATERAL label_pairs(t) p").collect()}
    want = {(p["kind"], p["k"], p["v"]) for p in spark.table("said").select(F.explode(T.label_pairs(F.col("t"))).alias("p")).select("p.*").collect()}
    assert got == want and (4, "issued", "3 May") in got and (1, "client", "Port Trust") in got


def test_dates_in_any_writing(spark):
    from sheafline.functions import dates

    cases = [
        ("the 3rd of May, 2021", D(2021, 5, 3)), ("May 3rd 2021", D(2021, 5, 3)), ("2021 Sept 9", D(2021, 9, 9)), ("7-sep-99", D(1999, 9, 7)), ("05.06.2020", D(2020, 6, 5)), ("13/02/2020", D(2020, 2, 13)), ("02-13-2020", D(2020, 2, 13)),
        ("2020.06.05", D(2020, 6, 5)), ("Contract 12 of 1999 dated June 5, 2021", D(2021, 6, 5)), ("no date", None), ("May 2021", None), ("31 Feb 2020", None), (None, None), ("", None), ("1 Jan 2020 and 2 Feb 2021", D(2020, 1, 1)), ("123456", None), ("march on 5", None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", dates.loose_date(F.col("t")).alias("d"), dates.loose_date(F.col("t"), day_first=False).alias("m"))
    got = {r["i"]: r for r in rows.collect()}
    assert [(t, got[i]["d"]) for i, (t, _) in enumerate(cases)] == cases
    assert got[4]["m"] == D(2020, 5, 6) and got[5]["m"] == D(2020, 2, 13)
    assert spark.range(1).select(dates.parse_date(F.lit("7-sep-99"), loose=True).alias("d")).first()["d"] == D(1999, 9, 7)


def test_lookups_in_the_store(spark):
    from sheafline.operators import store

    rows = certs(spark).withColumn("doc_type", F.when(F.col("doc_id") == "C1", "completion_certificate").otherwise("company_completion_certificate"))
    asked = spark.createDataFrame([("1", "ROADS dep"), ("2", "port_trust"), ("3", "r%s dep%"), ("4", None), ("5", "%_"), ("6", "100%"), ("7", "\\")], "qid string, pattern string")
    assert {tuple(r) for r in store.like_pairs(asked, store.all_clients(rows).withColumnRenamed("client", "name")).collect()} == {("1", "Roads Dept (PSU)"), ("1", "Roads Department"), ("2", "Port Trust"), ("3", "Roads Dept (PSU)"), ("3", "Roads Department")}
    assert {(r["qid"], r["doc_id"]) for r in store.client_projects(asked, rows).collect()} == {("1", "C1"), ("1", "C2"), ("2", "C3"), ("3", "C1"), ("3", "C2")}
    leads = spark.createDataFrame([("a", "rao"), ("b", "nobody")], "qid string, pattern string")
    assert {(r["qid"], r["doc_id"]) for r in store.engineer_projects(leads, rows).collect()} == {("a", "C1"), ("a", "C3")}
    people = spark.createDataFrame([("P1", "Asha Rao", "PMP", D(2021, 1, 1)), ("P2", "asha rao", "Six Sigma", None), ("P3", "B. Iyer", "PMP", None)], "doc_id string, engineer_name string, certification_type string, issue_date date")
    assert [(r["doc_id"], r["nth"]) for r in store.engineer_certifications(leads, people).orderBy("nth").collect()] == [("P2", 1), ("P1", 2)]
    assert [r["doc_id"] for r in store.engineer_certifications(leads.withColumn("kind", F.lit("pm")), people).collect()] == ["P1"]
    letters = spark.createDataFrame([("Port Trust", "a"), ("Port Trust", "a"), ("Port Trust", None), ("Roads Department", "b")], "issuing_client string, project_name string")
    assert {r["qid"]: r["letters"] for r in store.letter_counts(asked, letters).collect()} == {"1": 1, "2": 1, "3": 1, "4": 0, "5": 0, "6": 0, "7": 0}


def test_commands_from_questions_to_a_release(spark, tmp_path, capsys):
    import json

    from sheafline.__main__ import main

    questions = tmp_path / "q.json"
    questions.write_text(json.dumps({"questions": [{"qid": "a", "question": "Total value of all completed assignments of the Port Trust?", "answer_type": "money", "answer": 50.0, "shape": "s", "hops": 1}, {"qid": "b", "question": "nothing known", "answer_type": "percent"}]}))
    tables = tmp_path / "tables"
    certs(spark).write.parquet(str(tables / "certificates.parquet"))
    spark.createDataFrame([], "package_code string, issuing_client string, contract_value double").write.parquet(str(tables / "letters.parquet"))
    spark.createDataFrame([], "client_name string, invoiced double, received double").write.parquet(str(tables / "receivables.parquet"))
    spark.createDataFrame([], "doc_id string, engineer_name string, issue_date date").write.parquet(str(tables / "personnel.parquet"))
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    assert main(["self-test"], spark) == 0
    for _ in range(2):  # the second run finds all answers kept
        assert main(["e2e", str(questions), str(tables), out, "--cache", cache, "--report", str(tmp_path / "r.md")], spark) == 0
        assert {tuple(r) for r in spark.read.csv(out, header=True).collect()} == {("a", "50"), ("b", "50")}
    assert spark.read.parquet(cache).count() == 2 and "| shape | s | 1.00 |" in (tmp_path / "r.md").read_text()
    assert main(["answers", str(questions), str(tables), str(tmp_path / "plain")], spark) == 0 and spark.read.csv(str(tmp_path / "plain"), header=True).count() == 2
    capsys.readouterr()
    assert main(["freeze", str(questions), out], spark) == 0
    folder = capsys.readouterr().out.strip()
    assert {tuple(r) for r in spark.read.csv(folder + "/answers", header=True).collect()} == {("a", "50"), ("b", "50")}
    kept = json.loads(spark.read.text(folder + "/manifest", wholetext=True).first()[0])
    assert kept["rows"] == 2 and kept["validator_passed"] and spark.read.text(out + ".manifest").count() > 0
    (tmp_path / "bad.csv").write_text("question_id,answer\na,-5\nb,50\n")
    assert main(["freeze", str(questions), str(tmp_path / "bad.csv")], spark) == 1


def plain_similarity(a, b):
    """The token-set ratio from its definition, with the longest common subsequence by the whole table."""

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for i, d in enumerate(y, 1):
                last, row[i] = row[i], last + 1 if c == d else max(row[i], row[i - 1])
        return 200.0 * row[-1] / (len(x) + len(y)) if x or y else 100.0

    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both = " ".join(sorted(one & two))
    if both and (one <= two or two <= one):
        return 100.0
    left, right = ((both + " " + " ".join(sorted(x))).strip() for x in (one - two, two - one))
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


def test_resolution_is_that_of_comparing_everything(spark):
    """Every mention against every entity, layer by layer, without joins."""
    import re

    from sheafline.functions.names import COMMON

    random.seed(9)
    words = ["harbour", "water", "roads", "board", "trust", "north", "south", "department", "council", "zone", "bridge"]
    typo = lambda w: w if random.random() < 0.6 else w[: random.randint(4, len(w))] + random.choice(["x", "", "er"])
    entities = sorted({" ".join(random.sample(words, random.randint(2, 3))) for _ in range(25)})
    mentions = [(str(i), " ".join(typo(w) for w in random.choice(entities).split()) + random.choice(["", " works", " in 2020"])) for i in range(60)] + [("n", None), ("e", ""), ("t", "nothing")]
    telling = lambda t: set(re.findall(r"\b[a-z]{3,}\b", t)) - set(COMMON)
    want = {}
    for qid, text in mentions:
        text = text or ""
        held = sorted((e for e in entities if e in text), key=lambda e: (-len(e), e))
        scored = sorted((-(plain_similarity(e, text) + 5 * len(telling(e) & telling(text))), e) for e in entities if telling(e) & telling(text) and plain_similarity(e, text) >= 60)
        if held:
            want[qid] = (held[0], 1)
        elif scored and -scored[0][0] >= 78 and (len(scored) == 1 or scored[1][0] - scored[0][0] >= 5):
            want[qid] = (scored[0][1], 2)
        elif scored and -scored[0][0] >= 65:
            want[qid] = (scored[0][1], 5)
        else:
            want[qid] = (None, None)
    got = resolve.resolve(spark.createDataFrame(mentions, "qid string, text string"), spark.createDataFrame([(e,) for e in entities], "entity string")).collect()
    assert {r["qid"]: (r["entity"], r["layer"]) for r in got} == want and len(got) == len(mentions)
    assert {layer for _, layer in want.values()} == {1, 2, 5, None}


def test_cut_leaves_no_shuffle_files(spark):
    """what a kept table was made by does not stay on disk beside it."""
    from sheafline.operators.lineage import cut

    def files() -> set:
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in kept.split() if "/shuffle_" in f}

    before = files()
    rows = cut(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and rows.count() == 7


def test_nothing_found_leaves_mentions_as_they_are(spark, monkeypatch):
    """a layer that finds nothing does not write all mentions again, and words in no entity are not dealt out."""
    names = spark.createDataFrame([("Port Trust",), ("Roads Department",)], "entity string")
    said = spark.createDataFrame([("1", "quite another thing"), ("2", None)], "qid string, text string")
    written = []
    monkeypatch.setattr(resolve, "cut", lambda rows: written.append(rows.columns) or lineage.cut(rows))
    got = {tuple(r) for r in resolve.resolve(said, names).collect()}
    assert got == {("1", None, None), ("2", None, None)}
    assert sum("_text" in columns for columns in written) == 1


def test_client_groups_are_those_of_the_graph_and_make_nothing_else(spark, monkeypatch):
    """groups come without projects, people and pairs for review."""
    tables = others(spark)
    want = sorted((r["client_id"], r["component"]) for r in graph.entity_graph(certs(spark), **tables).clients.collect())
    for name in ("ambiguous_pairs", "projects_of"):
        monkeypatch.setattr(graph, name, None)
    got = graph.client_groups(certs(spark), *[tables[kind] for kind in ("letters", "bonds", "bills")])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 3
    assert graph.client_groups(certs(spark).where("false"), *[tables[kind].where("false") for kind in ("letters", "bonds", "bills")]).count() == 0


def test_records_are_read_once_for_the_whole_graph(spark):
    """every part of the graph used to work all certificates and their clients' keys out again."""
    read = spark.sparkContext.accumulator(0)
    rows = certs(spark)
    g = graph.entity_graph(rows.mapInArrow(lambda batches: ((read.add(b.num_rows), b)[1] for b in batches), rows.schema), **others(spark))
    for part in g:
        part.collect()
    assert read.value == rows.count()
