"""The operators on documents against brute-force versions, on rows with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from brute import capped_targets, plain_flow
from sheafline.llm import langid, lm, lz, mixing, packing, simhash, substring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, fingerprint string, doc int, th string, block string, start string"


def rows() -> list[tuple]:
    """Documents with near and exact copies, a shared passage, nulls, empty texts and one very long text."""
    random.seed(7)
    words = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(random.choices(words, k=n))
    passage = text(60)
    docs = [(i, text(random.randint(1, 120)), "en", f"s{i % 3}") for i in range(40)]
    docs += [(100 + i, f"{text(15)}\n{passage}\t{text(10)}", "fr", "s1") for i in range(6)]
    docs += [(200 + i, docs[3][1] + " x" * i, "en", None) for i in range(4)]
    docs += [(300, None, "en", "s2"), (301, "", None, "s2"), (302, "   \n", "de", None), (303, "a b a b a b " * 30, "de", "s0"), (304, text(3000), "en", "s0")]
    docs += [(None, text(30), "en", "s1"), (None, None, None, None), (7, text(50), "fr", "s1"), (7, docs[7][1], "en", "s1"), (305, "It's 'Ünï—SAM' <|endoftext|> J\u030c ΑΣ. \u00a0x\x1cy", "fr", "s2")]
    return [(*d, "clash", 1, "clash", "clash", "clash") for d in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "text").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_packing_is_an_exact_round_trip(docs, none):
    got = packing.pack_documents(docs, TOKENIZER, group=16).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for d in docs.collect():
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        data, at = np.array(ids, "<u4").tobytes(), 0
        while at < len(ids):
            n = 4096 if len(ids) - at >= 4096 else min(2048, len(ids) - at)
            want[d["doc_id"], at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), len(ids)] += 1
            at += n
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_rows_that_repeat_are_spread_over_the_packing_groups(spark):
    made = spark.createDataFrame([(None, None)] * 3000 + [(1, "same text")] * 3000, "doc_id long, text string").repartition(4)
    got = packing.pack_documents(made, TOKENIZER, group=100)
    groups = collections.Counter(r["sequence_id"] >> 32 for r in got.collect())
    assert sum(groups.values()) == 6000 and len(groups) == 60 and max(groups.values()) < 3 * 100


def test_another_tokenizer_is_refused():
    with pytest.raises(ValueError):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_full_windows_do_not_thin_out_the_groups_of_rests(spark):
    """40 rests of 20 tokens, each after ten full windows, in groups of about 8."""
    made = spark.createDataFrame([(i, "a " * 659) for i in range(40)], "doc_id long, text string")
    got = packing.pack_documents(made, TOKENIZER, window=64, longest_rest=32, group=8).collect()
    full = [r["sequence_id"] for r in got if r["length"] == 64]
    rests = [r for r in got if r["length"] != 64]
    assert len(full) == 400 and len(rests) == 40 and {r["length"] for r in rests} == {20}
    used = {r["sequence_id"] for r in rests}
    assert len(set(full)) == 400 and not used & set(full) and len(used) <= 14 + 5


def test_differencing_makes_near_equal_windows():
    random.seed(1)
    sizes = [random.randint(1, 2048) for _ in range(700)]
    parts = packing.near_equal_windows(sizes, 4096)
    assert sorted(i for part in parts for i in part) == list(range(700))
    sums = [sum(sizes[i] for i in part) for part in parts]
    assert max(sums) <= 4096 and max(sums) - min(sums) < 250
    assert len(parts) <= math.ceil(sum(sizes) / 4096) * 1.04
    assert packing.near_equal_windows([], 10) == [] and packing.near_equal_windows([10], 10) == [[0]]


def removed_by_force(rows_, k):
    seen, out = {}, []
    order = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows_), key=lambda x: (x[0], x[1] or ""))
    for doc, text in order:
        w = split(text)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            seen[key] = min(seen.get(key, (doc, i)), (doc, i))
    for doc, text in order:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] < (doc, i):
                gone[i : i + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((None if doc == -(2**63) else doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize(("k", "sub"), [(20, 8), (5, 3), (4, 4)])
def test_repeated_spans_are_removed(docs, none, k, sub):
    got = substring.remove_repeats(docs, k, sub, carry=("lang", "doc"))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "lang", "doc"]
    found = got.collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed_by_force(docs.collect(), k)
    assert {r["kept"] for r in found if r["doc_id"] == 300} == {None}
    assert substring.remove_repeats(none).count() == 0


def test_rows_of_one_id_are_told_apart_by_all_of_their_text(spark):
    """Rows under one id whose texts' hashes share their low 24 bits: each is cut by its own spans alone."""
    passage = " ".join(f"p{i}" for i in range(25))
    seen, alike = {}, []
    for i in range(60_000):
        text = f"{passage} {i} " + "tail " * (i % 2 * 40) if i % 2 else f"a{i} " * 5
        low = xxhash.xxh64_intdigest(text.encode(), 42) % 2**24
        if low in seen and len(split(seen[low])) != len(split(text)):
            alike += [seen[low], text]
        seen[low] = text
    assert len(alike) >= 20
    made = spark.createDataFrame([(None, t) for t in alike] + [(-1, "x y " + passage), (5, "z " + passage)], "doc_id long, text string")
    found = substring.remove_repeats(made).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed_by_force(made.collect(), 20)


def simhash_of(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints, least):
    root = dict.fromkeys(prints)
    label = {p: least[p] for p in prints}
    changed = True
    near = {a: [b for b in prints if (a ^ b).bit_count() <= 3] for a in root}
    while changed:
        changed = False
        for a in root:
            m = min(label[b] for b in near[a])
            if m < label[a]:
                label[a], changed = m, True
    return label


def test_simhash_groups(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = collections.defaultdict(list)
    for d in docs.collect():
        prints[simhash_of(d["text"])].append(-(2**63) if d["doc_id"] is None else d["doc_id"])
    label = components(list(prints), {p: min(v) for p, v in prints.items()})
    back = lambda x: None if x == -(2**63) else x
    want = collections.Counter((back(i), f"{p:016x}", back(label[p])) for p, v in prints.items() for i in v)
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_and_components_broadcast_nothing(spark):
    """A table of fingerprints is small as a file, but its probes are not: nothing of it may pass through the driver."""
    from sheafline.llm import components, simhash

    prints = simhash.saved(spark.createDataFrame([(x, x) for x in (1, 3, 7, 255 << 40)], "fp long, least long"))
    links = simhash.links(prints.select("fp"))
    labels = components.connected(prints.withColumnRenamed("fp", "node"), links)
    for rows in (links, labels):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in labels.collect()} == {(1, 1), (3, 1), (7, 1), (255 << 40, 255 << 40)}


@pytest.mark.parametrize("pairs_up_to", [64, 2, 0])
def test_links_join_what_chains_of_close_fingerprints_join(spark, pairs_up_to):
    """Large buckets, which get no pairs, link the same fingerprints."""
    random.seed(3)
    centre = [random.getrandbits(64) for _ in range(6)]
    flip = lambda x, n: x ^ sum(1 << b for b in random.sample(range(64), n))
    prints = sorted({flip(c, random.randint(0, 3)) for c in centre for _ in range(25)} | {flip(centre[0], n) for n in (4, 5, 6, 7)} | {0, 1, 3, 15, 2**63})
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fp long, least long")
    labels = simhash.connected(nodes.selectExpr("fp as node", "least"), simhash.links(nodes.select("fp"), pairs_up_to)).collect()
    want = components(prints, {p: i for i, p in enumerate(prints)})
    assert {r["node"]: r["least"] for r in labels} == {signed(p): v for p, v in want.items()}


def parse_by_force(data):
    known, ends, start = set(), [], 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            ends.append(end)
            start = end
    return known, ends


def test_phrases_are_those_of_the_plain_parse():
    for text in [r[1] or "" for r in rows()] + ["", "a", "aaaaaaa", "ab" * 300]:
        data = text.encode()
        assert lz.parse(data, {})[0] == parse_by_force(data)[1]
        cut = len(text) // 2
        one, two = lz.both_fingerprints(text[:cut], text[cut:], "other")
        assert (one == lz.both_fingerprints(text, "", None)[0]).all()
        assert (two == lz.both_fingerprints(text[:cut] + "other", "", None)[0]).all()


def plain_signature(text):
    """The 128-bin signature from the definition, with whole numbers; phrases are hashed as polynomials of their bytes."""
    mask, step = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    least: dict[int, int] = {}
    for phrase in parse_by_force(text.encode())[0]:
        h = mix((sum((b + 1) * pow(step, i, 2**64) for i, b in enumerate(phrase)) + len(phrase) * 0xD6E8FEB86659FD93) & mask)
        least[h >> 57] = min(h, least.get(h >> 57, h))
    own = [next((least[(b + i) % 128] for i in range(128) if (b + i) % 128 in least), None) for b in range(128)]
    return [0 if h is None else (h * step & mask) >> 48 for h in own]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(x == y for x, y in zip(plain_signature(a), plain_signature(b), strict=True)) / 128


def test_lz_fingerprints_of_edited_texts(docs, none):
    got = collections.Counter(tuple(r)[:3] + (r["near_edited"], r["near_next"], r["fingerprint"]) for r in lz.fingerprints_with_next(docs, parts=4).collect())
    order = sorted(docs.collect(), key=lambda d: (-(2**63) if d["doc_id"] is None else d["doc_id"], np.int64(np.uint64(xxhash.xxh64((d["text"] or "").encode(), seed=42).intdigest()))), reverse=True)
    want = collections.Counter()
    for d, e in zip(order, order[1:] + order[:1], strict=True):
        t, n = d["text"] or "", e["text"] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        want[d["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(t, edited), plain_likeness(t, n), "".join(f"{x:04x}" for x in plain_signature(t))] += 1
    assert got == want
    phrases = lambda t: parse_by_force(t.encode())[0]
    long, other = order[0]["text"], rows()[44][1]
    exact = len(phrases(long) & phrases(other)) / len(phrases(long) | phrases(other))
    assert abs(plain_likeness(long, other) - exact) < 0.15
    assert lz.fingerprints_with_next(none).count() == 0


def test_ids_that_repeat_are_spread_over_the_tasks(spark):
    """A third of all rows has a null id and one text, another a null id and its own text."""
    from pyspark.sql import functions as F

    same = [(None, "same")] * 3000
    made = spark.createDataFrame(same + [(None, f"text {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(3000)], "doc_id long, text string").repartition(4, "text")
    got = lz.fingerprints_with_next(made, parts=8)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == 9000 and len(sizes) == 8 and sizes[-1] < 3 * sizes[4]
    assert got.where("doc_id is null and n_chars = 4 and near_next = 1").count() == 2999


def test_scores_are_those_of_the_plain_model(docs, none, monkeypatch):
    for order in (2, 3):
        monkeypatch.setattr(lm, "AUTOMATON_TOKENS", 400 if order == 2 else 150_000)
        got = collections.defaultdict(list)
        for r in lm.score_documents(docs, order=order, piece_bytes=20_000).collect():
            got[r["doc_id"]].append(r)
        everything = docs.collect()
        tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        grams = [collections.Counter() for _ in range(order)]
        starts = 0
        for d in everything:
            if not held(d["doc_id"]):
                seq = ["<s>"] * (order - 1) + tokens(d["text"])
                starts += 1
                for i in range(order - 1, len(seq)):
                    for n in range(order):
                        grams[n][tuple(seq[i - n : i + 1])] += 1
        total, vocabulary, once = sum(grams[0].values()), len(grams[0]), sum(v == 1 for v in grams[0].values())
        unknown = (once + 1) / (total + vocabulary + 1)
        for d in everything:
            seq, base, score = ["<s>"] * (order - 1) + tokens(d["text"]), 0.0, 0.0
            for i in range(order - 1, len(seq)):
                c = grams[0][tuple(seq[i : i + 1])]
                base += math.log10((c + 1) / (total + vocabulary + 1))
                p = (1 - unknown) * c / total if c else unknown
                for n in range(1, order):
                    state = tuple(seq[i - n : i])
                    left = starts if i == order - 1 else grams[n - 1][state]
                    p = (grams[n][tuple(seq[i - n : i + 1])] + lm.MASS[n] * p) / (left + lm.MASS[n])
                score += math.log10(p)
            n = len(seq) - order + 1
            assert any(r["held_out"] == held(d["doc_id"]) and r["n_tokens"] == n and r["train_tokens"] == total and abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6 for r in got[d["doc_id"]])
    assert lm.score_documents(none).count() == 0


def test_the_automaton_is_a_distribution_from_every_state():
    """The arcs of a state and those behind its failure arcs, with an unknown token, share a probability of 1."""
    import pyarrow as pa

    tokens, offsets = lm.tokens_of(pa.array(["a b a b a c", "a b b", "", "c a b a"]))
    grams, first, counts = [], [], []
    for gram in lm.ngrams(tokens, offsets, 3):
        _, at_first, at = np.unique(gram, return_index=True, return_inverse=True)
        grams.append(at)
        first.append(at_first)
        counts.append(np.bincount(at).astype(float))
    model = lm.Automaton(grams, first, counts, offsets, len(tokens), 4.0, 0.1)
    assert len(model.lost) == 1 + 2 + len(counts[0]) + len(counts[1]) and model.failure[model.start] == 1
    ends = {grams[n - 1][at] for n in (1, 2) for at in offsets[1:] - 1}
    weight = {(arcs[i], token): arcs[i + 1] for token, arcs in zip(grams[0].tolist(), model.arcs, strict=True) for i in (0, 3, 6) if arcs[i] >= 0}
    for state in range(len(model.lost)):
        total = 0.0
        for token in [*range(len(counts[0])), -1]:
            at, lost = state, 0.0
            while (at, token) not in weight and at:
                lost, at = lost + model.lost[at], model.failure[at]
            total += 10 ** (lost + weight.get((at, token), model.unknown))
        # nothing follows an end, so what training saw after such a state does not add up to its count
        assert abs(total - 1) < 1e-9 or (state > 2 and total < 1 and ends)


def test_a_place_in_a_file_does_not_depend_on_the_tasks(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    want = collections.Counter((r["doc_id"], round(r["score"], 6)) for r in lm.score_documents(docs).collect())
    scored = lm.score_documents(stored, stored=True, piece_bytes=30_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in scored.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing_meets_its_targets(docs, none, spark):
    from pyspark.sql import functions as F

    got = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text"))).collect()
    again = mixing.mix(docs.repartition(5), F.array("source"), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = collections.defaultdict(int)
    for d in docs.collect():
        sizes[d["source"]] += len(split(d["text"]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, capped_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.defaultdict(int)
    for r in got:
        (source,) = r["sources"]
        taken[source] += r["taken"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source]) and r["taken"] <= 2 * r["size"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)
    assert mixing.mix(none, F.array("source"), mixing.word_count(F.col("text"))).count() == 0


def test_mixing_orders_rows_of_one_id_by_their_texts(spark):
    """The rows of a part pass are spread over the hash, not the smallest ones first."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(None, " ".join(f"w{k}" for k in range(i))) for i in range(1, 60)], "doc_id long, text string")
    got = mixing.mix(made, F.array(F.lit("s")), mixing.word_count(F.col("text")), carry=("text",)).collect()
    assert sum(r["taken"] for r in got) == 1.5 * sum(range(60)) and all(r["size"] == len(r["text"].split()) for r in got)
    twice = sorted(r["size"] for r in got if r["taken"] == 2 * r["size"])
    assert twice != list(range(1, len(twice) + 1))


def test_flow_is_the_cheapest_for_overlapping_sources():
    """Against all flows of a small network."""
    patterns, quotas = [(4, [0]), (3, [0, 1]), (2, [1])], [6, 6]
    flows = mixing.min_cost_flow(patterns, quotas, 2)
    assert [sum(f.get(s, 0) for f in flows) for s in (0, 1)] == quotas
    price = lambda used, words: min(used, words) + 2 * max(0, used - words)
    cost = sum(price(sum(f.values()), p[0]) for f, p in zip(flows, patterns, strict=True))
    best = min(price(a, 4) + price(b + c, 3) + price(d, 2) for a in range(9) for b in range(7) for c in range(7 - b) for d in range(5) if a + b == 6 and c + d == 6)
    assert cost == best


def cost_of(flows, patterns):
    used = [sum(f.values()) for f in flows]
    return sum(used), sum(min(u, w) + 2 * min(max(0, u - w), w) + 4 * max(0, u - 2 * w) for u, (w, _) in zip(used, patterns, strict=True))


def test_flow_is_that_of_the_plain_algorithm():
    random.seed(3)
    for _ in range(150):
        m = random.randint(1, 6)
        patterns = [(random.randint(0, 30), sorted(random.sample(range(m), random.randint(1, m)))) for _ in range(random.randint(1, 12))]
        quotas = [random.randint(0, 80) for _ in range(m)]
        flows = mixing.min_cost_flow(patterns, quotas, 3)
        assert cost_of(flows, patterns) == cost_of(plain_flow(patterns, quotas, 3), patterns)
        assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in enumerate(quotas)) and all(sum(f.values()) <= 3 * w for f, (w, _) in zip(flows, patterns, strict=True))


def test_flow_of_many_patterns():
    random.seed(4)
    m = 2_000
    patterns = [(random.randint(1, 1000), sorted(random.sample(range(m), 3))) for _ in range(20_000)]
    quotas = [random.randint(3000, 9000) for _ in range(m)]
    began = time.perf_counter()
    flows = mixing.min_cost_flow(patterns, quotas, 2)
    assert time.perf_counter() - began < 60 and sum(sum(f.values()) for f in flows) > 0.99 * min(sum(quotas), 2 * sum(w for w, _ in patterns))


def mixed_by_force(spark, rows, passes=2):
    """What is taken of (doc_id, text, sources): rows in the order of their hashes, cut where the flow of their pattern ends."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    key = F.hex(F.xxhash64(F.lit(mixing.SEED), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text"))
    by = collections.defaultdict(list)
    for r in df.withColumn("key", key).collect():
        by[tuple(sorted(set(r["sources"] or ()), key=lambda s: (s is None, s or "")))].append((r["key"].zfill(16), r["doc_id"], len(split(r["text"]))))
    names = sorted({s for sources in by for s in sources}, key=lambda s: (s is None, s or ""))
    words = {s: sum(n for sources, docs in by.items() if s in sources for _, _, n in docs) for s in names}
    targets = capped_targets([words[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    patterns = [(sum(n for _, _, n in docs), [names.index(s) for s in sources]) for sources, docs in by.items()]
    flows = plain_flow(patterns, [round(t) for t in targets], passes)
    taken = collections.Counter()
    for docs, (size, _), flow in zip(by.values(), patterns, flows, strict=True):
        whole, rest = divmod(sum(flow.values()), size) if size else (0, 0)
        for _, doc_id, n in sorted(docs, key=lambda x: (x[0], x[1] is None, x[1] or 0)):
            part = min(n, rest)
            rest -= part
            taken[doc_id, n, whole * n + part] += 1
    return taken, cost_of(flows, patterns)


@pytest.mark.parametrize("edge", [0, 4096])
def test_the_mix_takes_what_the_plain_flow_takes(spark, monkeypatch, edge):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    random.seed(9)
    single = [(i, " ".join(f"w{k}" for k in range(random.randint(0, 40))), [f"s{i % 4}"]) for i in range(120)] + [(None, None, None), (500, "a b", []), (501, "a b c", [None]), (502, "x " * 9, [None])]
    single += [(7, "same text of a few words", ["s1"])] * 9
    want, _ = mixed_by_force(spark, single)
    got = mixing.mix(spark.createDataFrame(single, "doc_id long, text string, sources array<string>"), F.col("sources"), mixing.word_count(F.col("text"))).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == want
    # overlapping sources have several cheapest flows; words and costs are those of the plain one
    both = single + [(1000 + i, " ".join("y" * random.randint(1, 20)), random.sample(["s0", "s1", "t", None], random.randint(1, 3))) for i in range(60)]
    _, best = mixed_by_force(spark, both)
    got = mixing.mix(spark.createDataFrame(both, "doc_id long, text string, sources array<string>"), F.col("sources"), mixing.word_count(F.col("text"))).collect()
    by = collections.defaultdict(lambda: [0, 0])
    for r in got:
        at = by[tuple(r["sources"])]
        at[0], at[1] = at[0] + r["size"], at[1] + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert cost_of([{0: taken} for _, taken in by.values()], [(size, None) for size, _ in by.values()]) == best


def test_any_number_of_sources(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_003).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("one two three four").alias("text"))
    got = mixing.mix(rows, F.array("source"), mixing.word_count(F.col("text"))).agg(F.count("*"), F.sum("taken"), F.max("taken"), F.sum("target")).first()
    assert got[0] == 20_003 and abs(got[1] - 1.5 * 4 * 20_003) <= 20_003 and got[2] <= 8 and got[3] == pytest.approx(1.5 * 4 * 20_003)


def test_languages_are_told(docs, none, spark):
    english, french = "the house and the tree with of this that were", "la maison et le jardin avec que dans une pour"
    random.seed(5)
    some = lambda words, n: " ".join(random.choices(words.split(), k=n))
    labelled = spark.createDataFrame([(i, some(english if i % 2 else french, 30), "en" if i % 2 else "fr") for i in range(80)], "doc_id long, text string, lang string")
    got = langid.predict_languages(labelled).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") and 0.5 < r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = langid.fit(labelled)
    assert model.predict("thewith") [0] == "en" and model.predict("avecque jardinette")[0] == "fr"  # unseen words, by n-grams
    for text in (None, "", "123 !? ²", "\n"):
        assert model.predict(text) == ("und", 0.0)
    messy = langid.predict_languages(docs).collect()
    assert len(messy) == docs.count() and all((r["lang_pred"] == "und") == (r["score"] == 0) for r in messy)
    assert langid.predict_languages(none).count() == 0
    assert langid.LanguageModel([]).predict("words") == ("und", 0.0)


def languages_by_force(learn, texts):
    """The method on plain dictionaries: learn has (text, lang), all of it the sample."""
    words, langs = collections.Counter(), sorted({lang for _, lang in learn})
    for text, lang in learn:
        words.update((w, lang) for w in re.findall(r"[^\W\d_]+", text.lower()))
    tables = [words] + [collections.Counter() for _ in range(langid.LONGEST_GRAM)]
    for (w, lang), n in words.items():
        for k in range(1, langid.LONGEST_GRAM + 1):
            for i in range(len(w) + 3 - k):
                tables[k][f" {w} "[i : i + k], lang] += n
    logs = []
    for table in tables:
        total = collections.Counter()
        for (x, _), n in table.items():
            total[x] += n
        kept = [x for x, n in total.items() if n >= langid.LEAST_COUNT]
        size = {lang: sum(table[x, lang] for x in kept) + langid.SMOOTHING * len(kept) for lang in langs}
        logs.append({x: [math.log((table[x, lang] + langid.SMOOTHING) / size[lang]) for lang in langs] for x in kept})

    def of(word):
        if word in logs[0]:
            return logs[0][word]
        for k in range(langid.LONGEST_GRAM, 0, -1):
            found = [logs[k][g] for i in range(len(word) + 3 - k) if (g := f" {word} "[i : i + k]) in logs[k]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    for text in texts:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            yield "und", 0.0
            continue
        sums = [sum(x) / len(found) * min(len(found), langid.EVIDENCE) for x in zip(*map(of, found), strict=True)]
        likely = [math.exp(x - max(sums)) for x in sums]
        yield langs[likely.index(max(likely))], max(likely) / sum(likely)


def test_languages_are_those_of_the_plain_model(docs):
    everything = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    want = collections.defaultdict(list)
    learn = [(t, lang) for i, t, lang in everything if not held(i) and t is not None and lang is not None]
    for (i, _, _), found in zip(everything, languages_by_force(learn, [t for _, t, _ in everything]), strict=True):
        want[i].append(found)
    got = langid.predict_languages(docs).collect()
    assert len(got) == len(everything)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and any(r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4 for lang, score in want[r["doc_id"]]), r


def test_no_language_is_left_out(spark):
    made = [(10 * i + j, " ".join(f"{'abcdefghijklmnopqrst'[i // 20]}{'abcdefghijklmnopqrst'[i % 20]}w{'xyz'[k]}" for k in range(3)), f"l{i:03}") for i in range(230) for j in range(2)]
    model = langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230 and all(model.predict(t)[0] == lang for _, t, lang in made)
