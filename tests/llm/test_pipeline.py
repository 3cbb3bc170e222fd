"""Each stage on its own input, against what its operator's brute-force version says."""

import collections

import corpus_pipeline
from brute import capped_targets
from sheafline.llm import langid, mixing, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents(spark):
    import random

    random.seed(11)
    words = {"en": "the of and to in house tree river stone with from this".split(), "fr": "le la et les des dans une pour avec que maison arbre".split()}
    made = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = " ".join(random.choice(words[lang]) + random.choice(["", "", "s", "ly", "er", str(i)]) for _ in range(random.randint(30, 90)))
        made.append((i, text, lang, f"s{i % 4}", len(text), "e"))
    passage = " ".join(random.choice(words["en"]) + str(k) for k in range(60))
    made += [(100 + i, f"{made[i][1]} {i} {passage} tail{i}", "en", "s1", 0, None) for i in range(3)]
    made += [(200, made[1][1], "en", "s2", 1, None), (201, "123 456", "en", "s0", 7, None), (202, None, "en", "s0", None, None), (203, "", None, None, 0, None), (1, made[1][1], "en", "s2", 1, None)]
    return spark.createDataFrame(made, SCHEMA)


def test_stages(spark):
    docs = documents(spark)
    names = [name for name, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    one = stage[names[0]](spark, docs, "")
    assert one.columns == docs.columns
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    assert collections.Counter(map(tuple, one.collect())) == collections.Counter(tuple(r) for r in docs.collect() if model.predict(r["text"])[1] >= 0.5)
    two = stage[names[1]](spark, one, "")
    label = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(one).collect()}
    assert two.columns == docs.columns
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({d for d, c in label if d == c})
    three = stage[names[2]](spark, two, "")
    kept = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(two).collect()}
    found = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == docs.columns and all(kept[i] == r["text"] for i, r in found.items())
    assert sum("31" in (r["text"] or "").split() or "t" in (r["text"] or "") for r in found.values())
    assert all(kept[i] == "" for i in kept if i not in found)
    four = stage[names[3]](spark, three, "")
    assert four.columns == docs.columns
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(four.collect()) - 1.5 * words(three.collect())) <= 5
    assert max(collections.Counter(r["doc_id"] for r in four.collect()).values()) <= 2
    five = stage[names[4]](spark, four, "").collect()
    tokens = collections.defaultdict(int)
    for r in five:
        tokens[r["sequence_id"]] += r["length"]
    assert max(tokens.values()) <= 4096 and {r["doc_id"] for r in five} == {r["doc_id"] for r in four.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else spark.createDataFrame(out.collect(), SCHEMA)


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    """Rows with null ids and with one id for different texts: groups are those of the fingerprints, not of the ids."""
    import random

    random.seed(5)
    text = lambda: " ".join(random.choices([f"w{i}" for i in range(400)], k=1500))
    base = [text() for _ in range(6)]
    made = [(None, base[0] + " x" * i) for i in range(12)] + [(None, base[1]), (None, base[1]), (4, base[1]), (None, base[2])]
    made += [(1, base[3]), (1, base[4] + " y"), (0, base[4]), (9, base[3] + " y"), (7, base[5]), (None, None), (None, ""), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s0", 0, None) for d, t in made], SCHEMA)
    prints = [r["fp"] for r in simhash.fingerprints(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made)], "doc_id long, text string")).orderBy("doc_id").collect()]
    group = list(range(len(made)))
    for _ in made:
        group = [min(group[j] for j in range(len(made)) if bin((prints[i] ^ prints[j]) % 2**64).count("1") <= 3) for i in range(len(made))]
    assert len(set(group)) == 7
    stay = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()
    found = sorted(group[made.index((r["doc_id"], r["text"]))] for r in stay)
    assert found == sorted(set(group))
    for r in stay:
        ids = [d for (d, _), g in zip(made, group, strict=True) if g == group[made.index((r["doc_id"], r["text"]))]]
        assert r["doc_id"] == min(ids, key=lambda d: -(2**63) if d is None else d)


def test_mixing_takes_rows_that_share_id_and_size_one_by_one(spark):
    """All rows have a null doc_id and 30 words: each source still gets its target."""
    made = [(None, " ".join(f"w{i // 2}x{k}" for k in range(30)), "en", f"s{i % 3}", 0, "e") for i in range(90)]
    docs = spark.createDataFrame(made, SCHEMA)
    four = dict(corpus_pipeline.STAGES)["mixing sources"](spark, docs, "")
    assert four.columns == docs.columns
    words = collections.Counter()
    for r in four.collect():
        words[r["source"]] += len(r["text"].split())
    targets = capped_targets([900] * 3, mixing.WEIGHTS)
    assert all(abs(words[f"s{i}"] - targets[i]) <= 1 for i in range(3))


CLASHING = ("kept", "n_words", "n_removed", "kept_sha256", "_size", "_words", "_taken", "_id", "_nth", "_language", "size", "taken", "row", "doc", "th", "part", "n", "id", "others", "_pattern", "a.b", "block")


def test_extra_columns_of_any_name_stay_as_they_are(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, ""), stage(spark, wide, "")
        assert out.columns == wide.columns, name
        got = out.collect()
        assert collections.Counter(tuple(r[c] for c in docs.columns) for r in got) == collections.Counter(map(tuple, plain.collect())), name
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_near_duplicates_that_differ_in_other_columns_go_by_those(spark):
    made = [(1, "same text here again", "en", s, 0, e) for s, e in (("b", "x"), ("a", "y"), ("a", "x"), (None, "z"))]
    for rows in (made, made[::-1]):
        out = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
        assert [(r["source"], r["extra"]) for r in out] == [("a", "x")]


def test_near_dedup_broadcasts_nothing(spark):
    """What is kept is small as a file, but the driver has no room for it at size."""
    docs = simhash.saved(documents(spark))
    rows = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
