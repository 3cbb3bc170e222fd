"""Works, resolution, entities, quality and the two solvers."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from sheafline import queries
from sheafline.operators import entities, quality, resolve, works
from sheafline.plans import baseline, primary

CERTS = "doc_id string, doc_type string, client_name string, package_code string, project_name string, category string, contract_value decimal(18,2), completion_date date, project_lead string"


def certs(spark):
    d = datetime.date
    rows = [
        ("C1", "completion_certificate", "Roads Board", "Pkg-1", "Road — A", "roads", 100, d(2019, 5, 1), "Asha Rao"),
        ("C2", "company_completion_certificate", "Roads Board", "Pkg-1", "Road — A", "roads", 120, d(2019, 5, 1), "Asha Rao"),
        ("C3", "company_completion_certificate", "roads board", "Pkg-2", "Bridge — B", None, 400, d(2022, 1, 1), "Asha Rao"),
        ("C4", "completion_certificate", "Roads Board", None, "Tunnel", "tunnels", 70, None, None),
        ("C5", "completion_certificate", "Port Trust", "Pkg-9", "Quay", "dam", None, d(2020, 1, 1), "B. Iyer"),
    ]
    return spark.createDataFrame([tuple(decimal.Decimal(v) if isinstance(v, int) else v for v in r) for r in rows], CERTS)


def test_portfolios(spark):
    got = {r["doc_id"] for r in works.portfolio_primary(certs(spark)).collect()}
    assert got == {"C2", "C3", "C4", "C5"}
    got = {r["doc_id"] for r in works.portfolio_baseline(certs(spark)).collect()}
    assert got == {"C1", "C3", "C4", "C5"}


def test_portfolios_do_not_depend_on_the_order_of_rows(spark):
    rows = certs(spark).collect()
    random.seed(0)
    want = sorted(map(str, works.portfolio_primary(certs(spark)).collect()))
    for _ in range(3):
        random.shuffle(rows)
        assert sorted(map(str, works.portfolio_primary(spark.createDataFrame(rows, CERTS)).collect())) == want


def test_last_write_wins_and_gap(spark):
    rows = spark.createDataFrame([("q", 1, 5.0), ("q", 2, 7.0), ("r", 3, 1.0)], "qid string, row_num int, answer double")
    assert {(r["qid"], r["answer"], r["duplicated"]) for r in works.last_write_wins(rows).collect()} == {("q", 7.0, True), ("r", 1.0, False)}
    assert [tuple(r) for r in works.largest_gap(rows, ["qid"], "answer").collect()] == [("q", 2.0)]


@pytest.mark.parametrize(
    ("question", "kind", "client", "engineer", "shape", "answer"),
    [
        ("Total value of all completed assignments?", "money", "Roads Board", None, "hop_aggregate", 590.0),
        ("Portfolio excluding the tunnels segment, please", "money", "Roads Board", None, "exclusion_aggregate", 520.0),
        ("Between 2019 and 2022 how has the value moved between 2019 and 2022?", "money", "Roads Board", None, "year_gap", 280.0),
        ("How many lack a client reference?", "count", "Roads Board", None, "absence", 2.0),
        ("Share that carry formal verification?", "percent", "Roads Board", None, "referenced_share", 33.33),
        ("What has been billed?", "percent", "Roads Board", None, "collection_pct", 75.0),
        ("What is the shortfall?", "money", "Roads Board", None, "billing_gap", 390.0),
        ("The difference of the mean and the median?", "money", "Roads Board", None, "mean_median_gap", 77.0),
        ("Works at or over the one hundred mark", "money", "Roads Board", None, "threshold_aggregate", 520.0),
        ("What is the average size?", "money", "Roads Board", None, "avg_work_size", 197.0),
        ("How much work to reach the 1,000 mark?", "money", "Roads Board", None, "gap_to_threshold", 410.0),
        ("By how much does the largest work exceed all?", "money", "Roads Board", None, "rank_value_gap", 280.0),
        ("How many distinct work classifications?", "count", None, "Asha Rao", "distinct_count", 2.0),
        ("Value of all completed after her PMP?", "money", None, "Asha Rao", "temporal_chain", 400.0),
        ("How long did it take?", "days", None, "Asha Rao", "date_span", 679.0),
        ("Days until the Quay was handed over?", "days", None, None, "date_span", 434.0),
        ("Anything else?", "count", None, None, "fallback", 1.0),
        ("Total excluding nothing known", "money", None, None, "fallback", 1e8),
    ],
)
def test_primary_shapes(spark, question, kind, client, engineer, shape, answer):
    q = spark.createDataFrame([("q", question, kind, client, engineer, None)], "qid string, question string, answer_type string, client string, engineer string, package string")
    letters = spark.createDataFrame([("pkg-2", "Roads Board", None)], "package_code string, issuing_client string, contract_value decimal(18,2)")
    money = spark.createDataFrame([("Roads Board", 200.0, 150.0)], "client_name string, invoiced double, received double")
    people = spark.createDataFrame([("P1", "Asha Rao", datetime.date(2020, 6, 1))], "doc_id string, engineer_name string, issue_date date")
    assert [tuple(r) for r in primary.solve(q, certs(spark), letters, money, people).collect()] == [("q", shape, answer)]


def test_baseline_shapes(spark):
    asked = [
        ("1", "Total delivered for Roads Board?", "money", 570.0), ("2", "Mean size for Roads Board?", "money", 190.0), ("3", "By how much is the largest over the second largest of Roads Board?", "money", 300.0),
        ("4", "Roads Board works crossing Rs. 90?", "money", 500.0), ("5", "Roads Board excluding tunnel, what is left?", "money", 500.0), ("6", "How many of Roads Board have no client reference?", "count", 2.0),
        ("7", "Collection for Roads Board?", "percent", 88.5), ("8", "Share of completed works of Roads Board divided by the total?", "percent", 33.33), ("9", "Value after that date by Asha Rao?", "money", 400.0),
        ("10", "How many days from certificate of Asha Rao to Bridge?", "days", 397.0), ("11", "Distinct kinds by Asha Rao?", "count", 2.0), ("12", "Additional work for Roads Board to INR 1,000?", "money", 430.0), ("13", "Unknown?", "money", 5e8),
    ]
    q = spark.createDataFrame([a[:3] for a in asked], "qid string, question string, answer_type string")
    letters = spark.createDataFrame([("Roads Board", "Road — A")], "issuing_client string, project_name string")
    people = spark.createDataFrame([("P1", "Asha Rao", datetime.date(2020, 6, 1))], "doc_id string, engineer_name string, issue_date date")
    got = {r["qid"]: r["answer"] for r in baseline.solve(q, certs(spark), letters, people).collect()}
    assert got == {a[0]: a[3] for a in asked}


def test_resolution_by_layers(spark):
    names = spark.createDataFrame([("Public Works Department, Uttar Pradesh",), ("Public Works Department, Madhya Pradesh",), ("Harbour Engineering Authority",)], "entity string")
    asked = [("1", "works for the PWD, Uttar Pradesh in 2020"), ("2", "harbour enginering authority bridges"), ("3", "who built Pkg-9?"), ("4", "nothing at all"), ("5", "what did Asha lead?"), ("6", None)]
    got = {r["qid"]: (r["entity"], r["layer"]) for r in resolve.resolve(spark.createDataFrame(asked, "qid string, text string"), names, certs(spark)).collect()}
    assert got["1"][1] in (1, 2) and got["1"][0].endswith("Uttar Pradesh")
    assert got["2"] == ("Harbour Engineering Authority", 2)
    assert got["3"] == ("Port Trust", 3) and got["5"] == ("Roads Board", 3) and got["4"] == (None, None) and got["6"] == (None, None)
    assert resolve.token_set_similarity("a b", "b a c") == 100.0 and resolve.token_set_similarity("", "a") == 0.0


def test_entities(spark):
    letters = spark.createDataFrame([("L1", "Pkg-1", "Road — A long name", "Roads Board", 90.0)], "doc_id string, package_code string, project_name string, issuing_client string, contract_value double")
    bonds = spark.createDataFrame([("BOND-0044", None, None, "Roads Board")], "doc_id string, package_code string, project_name string, beneficiary string")
    bills = spark.createDataFrame([("B1", "Pkg-1", None, "X"), ("B2", "Pkg-77", None, "X")], "doc_id string, package_code string, project_name string, client_name string")
    got = {r["package"]: r for r in entities.projects(certs(spark), letters, bonds, bills).collect()}
    assert set(got) == {"Pkg-1", "Pkg-2", "Pkg-4", "Pkg-9", "Pkg-44"} and got["Pkg-1"]["has_letter"] and got["Pkg-44"]["has_bond"] and got["Pkg-1"]["bills"] == ["B1"]
    assert got["Pkg-1"]["project_name"] == "Road — A" and got["Pkg-44"]["project_name"] == "Pkg-44" and float(got["Pkg-1"]["contract_value"]) == 120.0 and got["Pkg-1"]["documents"] == ["B1", "C1", "C2", "L1"]
    ids = entities.clients(spark.createDataFrame([("Roads Dept (PSU)",), ("Roads Department",), ("Port Trust",)], "client_raw string")).collect()
    assert {(r["client_id"], r["name"]) for r in ids} == {("CLIENT-001", "Port Trust"), ("CLIENT-002", "Roads Department")}
    pairs = entities.ambiguous_pairs(spark.createDataFrame([(1, "Roads Board of North Zone"), (2, "North Zone Ports"), (3, "Ports Board")], "id int, n string"), "id", "n")
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 2)]


def test_quality_of_answers(spark):
    q = spark.createDataFrame([("a", "money", 100.0, "x"), ("b", "percent", 50.0, "x"), ("c", "count", 3.0, "y")], "qid string, answer_type string, gold double, shape string")
    a = spark.createDataFrame([("a", "90", 1), ("a", "INR 95", 2), ("b", "0.9019", 3), ("z", "1", 4)], "qid string, raw_answer string, row_num int")
    codes = {(r["qid"], r["code"], r["severity"]) for r in quality.validate(q, a).collect()}
    assert codes == {("a", "DUPLICATE_QID_ROW", "WARNING"), ("b", "FRACTION_PERCENT_SUSPECTED", "WARNING"), ("c", "MISSING_QUESTION_ID", "ERROR"), ("z", "UNEXPECTED_QUESTION_ID", "WARNING")}
    summary = quality.validation_summary(q, a).collect()[0]
    assert (summary["expected"], summary["found"], summary["errors"], summary["is_valid"]) == (3, 2, 1, False)
    assert {(r["qid"], r["answer"]) for r in quality.repair(q, a).collect()} == {("a", 95.0), ("b", 90.19), ("c", 2.0)}
    scored = quality.scored(q, a)
    assert {r["qid"]: round(r["score"], 4) for r in scored.collect()} == {"a": 0.95, "b": 0.018, "c": 0.0}
    table = {(r["dimension"], r["value"]): r["questions"] for r in quality.breakdown(scored, ("shape", "answer_type")).collect()}
    assert table[("shape", "x")] == 2 and table[("all", None)] == 3
    assert {r["bucket"]: r["count"] for r in quality.histogram(scored).collect()}["zero"] == 1


def test_diff(spark):
    base = spark.createDataFrame([("a", 90.0), ("b", 1.0), ("c", 5.0)], "qid string, answer double")
    cand = spark.createDataFrame([("a", 100.0), ("b", 2.0), ("c", 5.0), ("d", 1.0)], "qid string, answer double")
    gold = spark.createDataFrame([("a", 100.0), ("b", 1.0)], "qid string, gold double")
    assert {r["qid"]: r["status"] for r in quality.compare(base, cand, gold).collect()} == {"a": "IMPROVED", "b": "REGRESSED", "c": "UNCHANGED", "d": "DIFFERENT"}


def test_anomalies(spark):
    q = spark.createDataFrame([(str(i), "percent") for i in range(40)], "qid string, answer_type string")
    a = spark.createDataFrame([(str(i), "0.5" if i < 20 else "0" if i < 35 else str(i), i) for i in range(40)], "qid string, raw_answer string, row_num int")
    assert {r["code"] for r in quality.anomalies(q, a).collect()} == {"FREQUENT_VALUE", "MANY_ZEROS", "FRACTION_PERCENTS"}


def test_contained_pairs_are_those_of_the_cross_product(spark):
    import random

    from sheafline.operators.contain import contained_pairs

    random.seed(2)
    word = lambda n: "".join(random.choices("abc ", k=n))
    texts = [(i, word(random.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (3, "aaaa bbbb"), (92, "é€aa")]
    needles = [word(random.randint(0, 7)) for _ in range(120)] + [None, "", "€a", "zzzzz", "a"]
    got = contained_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "name string")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == {(i, n) for i, t in texts for n in needles if t and n and n in t}
    assert contained_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_upper_median_of_keys_of_any_size(spark):
    import random

    from sheafline.operators import quality

    random.seed(8)
    rows = [("big", random.choice([0.0, 1.5, float(random.randint(0, 10**6))])) for _ in range(5000)] + [("two", 1.0), ("two", 2.0), ("one", -3.0), ("same", 7.0), ("same", 7.0), (None, 4.0), ("big", None)]
    got = {r[0]: r[1] for r in quality.upper_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    want = {k: sorted(v for x, v in rows if x == k and v is not None) for k in {k for k, _ in rows}}
    assert got == {k: v[len(v) // 2] for k, v in want.items()}


def test_the_distribution_of_answers_works_out_the_last_answers_once(spark):
    from sheafline.operators import reports

    questions = spark.createDataFrame([(1, "money"), (2, "money"), (3, "days"), (4, "days")], "qid int, answer_type string")
    answers = spark.createDataFrame([(1, "7", 1), (1, "5", 2), (2, "0", 3), (3, "x", 4), (9, "1", 5)], "qid int, raw_answer string, row_num int")
    got = reports.distribution_of_answers(questions, answers)
    assert [tuple(r) for r in got.collect()] == [("money", 2, 0.0, 5.0, 5.0, 1)]
    assert "row_num" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_files_of_answers(spark):
    from sheafline.operators import quality

    issues = lambda lines: [tuple(r) for r in quality.file_issues(spark.createDataFrame(list(enumerate(lines)), "row_num int, line string")).collect()]
    assert issues([]) == issues(["", "  "]) == [("HEADER", "EMPTY_FILE", "ERROR")]
    assert issues(['"QID" , answer', "a,1"]) == issues(["", "x,question_id", "1,a"]) == []
    assert issues(["a,1"]) == [("HEADER", "MISSING_STANDARD_HEADER", "WARNING")]


def test_numbers_count_up_whatever_the_bounds_of_the_ranges(spark):
    """Bounds that come from small samples differ each time that they are drawn."""
    from sheafline.operators.entities import numbered

    keys = spark.range(0, 20000, 1, 8).select(F.format_string("k%020d", F.xxhash64("id")).alias("key"), F.repeat(F.lit("x"), 40).alias("name")).dropDuplicates(["key"])
    settings = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = [r["n"] for r in numbered(keys, "key", "%d", "n").orderBy("key").select("n").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [str(i + 1) for i in range(len(got))]


def test_names_alike_but_for_their_ends_make_few_candidates(spark):
    from sheafline.operators import contain

    names = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("name"), F.lit(16).alias("n"))
    texts = names.select(F.concat(F.lit("total of the works of "), "name", F.lit("?")).alias("text"))
    begins = contain._begins(names)
    assert contain.candidates(texts, names, begins).count() <= 2 * 3000
    got = contain.contained_pairs(texts.withColumn("id", F.col("text")), names.select("name")).collect()
    assert sorted(tuple(r) for r in got) == [(f"total of the works of customer#{i:09d}?", f"customer#{i:09d}") for i in range(3000)]


@pytest.mark.parametrize("characters", [0, 10**6])
def test_names_of_any_length_are_found_with_and_without_a_broadcast(spark, monkeypatch, characters):
    from sheafline.operators import contain

    monkeypatch.setattr(contain, "BROADCAST_CHARACTERS", characters)
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    texts = [(1, long), (2, "x" + long[:40] + "y"), (3, "é" + long[5:9]), (3, "road é"), (4, ""), (5, None), (6, long)]
    needles = [long[i : i + n] for i, n in ((0, 1), (1, 2), (2, 3), (5, 4), (7, 9), (3, 15), (1, 33), (0, 78), (0, 50))] + ["é", "road", "roads", "", None]
    got = contain.contained_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "name string")).collect()
    want = {(i, n) for i, t in texts for n in needles if t and n and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_of_frequent_names_are_made_block_by_block(spark):
    """Every pair of rows, against comparing all of them; words are compared by groups of names, never pair by pair."""
    names = [(i, ["large ring", "Large Ring", "ring large old", "ring of brass", "the ring, (large) dept", "brass old", None][i * i % 7]) for i in range(90)]
    names += [(3, "ring large old"), (3, "brass old"), (None, "large ring"), (200, ""), (201, "lone odd"), (202, "lone odd"), (203, "lone odd thing")]
    words = lambda n: {w for w in n.lower().replace(",", " ").replace("(", " ").replace(")", " ").split() if w not in ("the", "of", "dept")}
    known = [(i, n) for i, n in names if i is not None and n is not None]
    want = sorted((a, b, len(words(m) & words(n)), m, n) for a, m in known for b, n in known if a < b and len(words(m) & words(n)) >= 2)
    table = spark.createDataFrame(names, "id int, n string")
    made = entities.ambiguous_pairs(table, "id", "n", carry=("n",), block=8)
    assert sorted(tuple(r) for r in made.collect()) == want and len(want) > 500
    plain = entities.ambiguous_pairs(table, "id", "n")
    assert sorted(tuple(r) for r in plain.collect()) == sorted(w[:3] for w in want)
    assert "array_intersect" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_resolution_broadcasts_no_mentions(spark):
    mentions = spark.createDataFrame([("1", "the harbour trust works"), ("2", "nothing")], "qid string, text string")
    found = resolve.resolve(mentions, spark.createDataFrame([("Harbour Trust",)], "entity string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("1", "Harbour Trust", 1), ("2", None, None)}


def test_gaps_are_exact_at_a_half(spark):
    """sums are subtracted as decimals: as doubles these two are not a half apart, and round the other way."""
    assert 1200000.37 - 815497.87 != 384502.5
    rows = [("1", "Roads Board", "Pkg-1", "A", None, 1200000.37, datetime.date(2021, 5, 1), None), ("2", "Roads Board", "Pkg-2", "B", None, 815497.87, datetime.date(2023, 5, 1), None)]
    made = spark.createDataFrame(rows, "doc_id string, client_name string, package_code string, project_name string, category string, contract_value double, completion_date date, project_lead string")
    q = spark.createDataFrame([("q", "How far was it moved between 2021 and 2023?", "money", "Roads Board", None, None)], "qid string, question string, answer_type string, client string, engineer string, package string")
    none = spark.createDataFrame([], "package_code string, issuing_client string, contract_value double")
    money = spark.createDataFrame([], "client_name string, invoiced double, received double")
    people = spark.createDataFrame([], "doc_id string, engineer_name string, issue_date date")
    assert [tuple(r) for r in primary.solve(q, made, none, money, people).collect()] == [("q", "year_gap", 384502.0)]


def test_names_that_repeat_are_answered_once(spark):
    """a client's receivables add up, and works after the certificates of several people of one name count for each of them."""
    day = lambda m: datetime.date(2021, m, 1)
    rows = [("1", "Roads Board", "Pkg-1", "A", "roads", 100.0, day(2), "Asha Rao"), ("2", "Roads Board", "Pkg-2", "B", "roads", 30.0, day(4), "asha rao"), ("3", "Roads Board", "Pkg-3", "C", "roads", 5.0, day(6), "Asha Rao")]
    made = spark.createDataFrame(rows, "doc_id string, client_name string, package_code string, project_name string, category string, contract_value double, completion_date date, project_lead string")
    asked = [("1", "What has been billed?", "percent", "Roads Board", None, None), ("2", "Value of all completed after her PMP?", "money", None, "Asha Rao", None)]
    q = spark.createDataFrame(asked, "qid string, question string, answer_type string, client string, engineer string, package string")
    none = spark.createDataFrame([], "package_code string, issuing_client string, contract_value double")
    money = spark.createDataFrame([("Roads Board", 60.0, 10.0), ("Roads Board", 20.0, 10.0)], "client_name string, invoiced double, received double")
    people = [("P1", "Asha Rao", "E1", day(4)), ("P2", "Asha Rao", "E1", day(1)), ("P3", "Asha Rao", "E2", day(3)), ("P4", "Asha Rao", "E3", day(6))]
    people = spark.createDataFrame(people, "doc_id string, engineer_name string, employee_id string, issue_date date")
    solved = lambda people: sorted(tuple(r) for r in primary.solve(q, made, none, money, people).collect())
    assert solved(people) == [("1", "collection_pct", 25.0), ("2", "temporal_chain", 5.0 + 35.0)]
    assert solved(people.drop("employee_id")) == [("1", "collection_pct", 25.0), ("2", "temporal_chain", 5.0)]


def test_every_layer_of_fuzzy_resolve_finds_something(spark, tmp_path):
    """every text held its part's type, so containment found all mentions and nothing was left for the other layers."""
    rows = [(i, name, kind, f"Brand#{i}") for i, (name, kind) in enumerate([("hot ring", "LARGE"), ("cold bolt", "SMALL"), ("hot ring", "SMALL"), ("cold bolt", "LARGE")] * 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {int(r["qid"]): (r["entity"], r["layer"]) for r in queries.fuzzy_resolve(spark, str(tmp_path)).collect()}
    want = {0: ("LARGE hot ring", 1), 1: ("SMALL cold bolt", 2), 2: ("SMALL hot ring", 2), 3: ("LARGE cold bolt", 5)}
    assert got == {i: (None, None) if i % 10 == 9 else want[i % 4] for i in range(20)}


def test_questions_are_put_in_lower_case_once_and_searched_only_where_a_name_can_begin(spark):
    """every word of every gate put the question in lower case again, and texts without a name were gone through place by place."""
    from sheafline.operators import contain

    q = spark.createDataFrame([("q", "The shortfall, BILLED?", "money", None, None, None)], "qid string, question string, answer_type string, client string, engineer string, package string")
    assert primary._parameters(q)._jdf.queryExecution().optimizedPlan().toString().count("lower(question") <= 3
    names = spark.createDataFrame([("harbour trust", 12), ("road", 4)], "name string, n int")
    leads = contain._leads(names)
    assert sorted(leads) == ["arbo", "harb", "road"]
    texts = spark.createDataFrame([("the harbour trust",), ("no such name here",), ("Harbour",)], "text string")
    parts = texts.select("text", contain._of_texts(contain._begins(names), leads)).where("part is not null")
    assert {r["text"] for r in parts.collect()} == {"the harbour trust"}
    assert contain._leads(spark.range(40).select(F.format_string("%04d road", "id").alias("name"), F.lit(8).alias("n"))) == []
