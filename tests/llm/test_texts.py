"""Fill-in-the-middle, periodic runs and chat formatting against plain versions and exact round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sheafline.llm import chat, fim, runs

SCHEMA = "doc_id long, text string, n int, form string, key string, cut string, words string, runs string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def texts() -> list[tuple]:
    random.seed(3)
    words = ["ab", "C", "é", "zß", "x1", "<", "<S", "🤦", "\u2028", "\x1c"]
    made = [(i, "".join(random.choice(words) + random.choice([" ", "\n", "", "\t "]) for _ in range(random.randint(0, 60)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, " \n"), (203, "has <M> in it"), (204, "a" * 10_000), (205, "ab é " * 20_000), (206, "x" * 4095 + "yz "), (None, "no id here"), (None, "no id here"), (7, "again"), (7, "again")]
    made += [(300 + i, "p q r " * (4 + i % 3) + "s t") for i in range(40)]
    return [(*t, 1, "clash", "clash", "clash", "clash", "clash") for t in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n = len(units)
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_moved_and_come_back(docs, none):
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    want = collections.Counter((*plain_fim(t[0], t[1]), t[1] or "") for t in texts())
    assert collections.Counter(tuple(r) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_slabs_end_where_units_end():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(fim.PATTERN), "isolated").pre_tokenize_str
    for text in ("", "a", "x" * 4096, "x" * 4097, "x" * 4095 + " y", " " * 9000, "é" * 4095 + "ab" * 3000 + "é"):
        assert fim.unit_starts(text, split).tolist() == [m.start() for m in re.finditer(fim.PATTERN, text, re.DOTALL)]


def plain_runs(words):
    """Every stretch with every period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def test_runs_of_random_words():
    rng = np.random.default_rng(1)
    for trial in range(400):
        kinds, n = int(rng.integers(1, 4)), int(rng.integers(0, 90))
        words = rng.integers(0, kinds, n)
        if trial % 2 and n > 8:
            q = int(rng.integers(1, n // 4 + 1))
            a = int(rng.integers(0, n - 4 * q + 1))
            words[a : a + 4 * q] = np.tile(words[a : a + q], 4)
        found = runs.runs_of(words)
        assert found == plain_runs(words.tolist())
        assert [words[i] for i in np.flatnonzero(runs.kept_words(n, found))] == plain_collapse(words.tolist(), found)


def test_runs_stand_when_hashes_are_shared(monkeypatch):
    """With hashes that only tell how many words a stretch has, the words alone decide."""
    monkeypatch.setattr(runs, "mix64", lambda x: np.zeros_like(x))
    for words in ([0] * 5 + [1, 2] * 5 + [3] * 6, list(range(30)), [0, 1] * 20, [0] * 12 + [1]):
        assert runs.runs_of(np.array(words)) == plain_runs(words)


def test_runs_in_blocks_of_pairs(monkeypatch):
    words = np.array([i % 7 for i in range(300)] + list(range(100, 200)) + [1, 2, 3] * 50)
    whole = runs.runs_of(words)
    monkeypatch.setattr(runs, "PAIRS", 5)
    assert runs.runs_of(words) == whole == plain_runs(words.tolist())


def test_thue_morse_words_have_no_long_runs():
    words = np.array([bin(i).count("1") % 2 for i in range(5000)])
    assert runs.runs_of(words) == []  # a sequence on which polynomial hashes modulo a power of two fail


def plain_repeats(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_of_documents(docs, none, spark):
    got = runs.digests(runs.periodic_runs(runs.with_repeats(docs))).collect()
    want = collections.Counter()
    for doc_id, text, *_ in texts():
        words = plain_repeats(doc_id, text)
        found = plain_runs(words) if len(words) < 5000 else [(0, len(words), 2)]
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        kept = plain_collapse(words, found) if len(words) < 5000 else words[:2]
        want[(doc_id, len(found), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert runs.periodic_runs(none).count() == 0
    whole = runs.periodic_runs(spark.createDataFrame([(1, "a\u00a0b c c c c c c d")], "doc_id long, text string")).first()
    assert (whole["n_words"], [tuple(r) for r in whole["runs"]], whole["collapsed"]) == (8, [(1, 6, 1)], "a\u00a0b c d")


def talks() -> list[tuple]:
    random.seed(5)
    bits = ["### ", "</turn>", "\\", "\n</turn>\n", "### User: ", "# ", "word ", "é🤦", "\n", '"', "####  ", "\r\n", "</tur", "n>"]
    made = [(c, t, random.choice(["user", "assistant", "system", "tool", 'a"b\\: ', "", None, "User", "x\n### y"]), "".join(random.choices(bits, k=random.randint(0, 12)))) for c in range(60) for t in range(random.randint(1, 7))]
    made += [(100, 0, "user", None), (100, None, "assistant", "first"), (100, 1, "assistant", "tie b"), (100, 1, "assistant", "tie a"), (100, 1, "assistant", "tie a")]
    made += [(None, 0, "user", "no id"), (None, 1, "assistant", "still none"), (101, 0, "assistant", "long " * 50_000), (101, 1, "assistant", "\\" * 1000)]
    return [(*t, "clash", "clash", 1) for t in made]


TALK = "conv_id long, turn long, role string, text string, rendered string, formatted string, start int"


def plain_reading(rows):
    """The contract's columns from the source; ties by the rendered turn."""
    by = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        rendered = chat.render(role or "", text or "")[0]
        by[conv].append((turn is not None, turn or 0, rendered.encode(), role or "", text or "", rendered))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t[4] for t in turns if t[3] == "assistant")
        out.add((conv, len(turns), sha("".join(f"{t[3]}\n{t[4]}\n" for t in turns)), len(learned), sha(learned), sum(len(t[5]) for t in turns)))
    return out


@pytest.mark.parametrize("longest", [1 << 20, 50])
def test_conversations_come_back(spark, longest):
    talk = spark.createDataFrame(talks(), TALK).repartition(3, "text")
    pieces = chat.format_conversations(chat.with_trial(talk), longest)
    got = chat.read_back(pieces).collect()
    trial = [(-7, 0, "user", chat.TRIAL), (-7, 1, "assistant", chat.TRIAL)]
    assert {tuple(r) for r in got} == plain_reading(talks() + trial) and len(got) == 64
    whole = collections.defaultdict(dict)
    for r in pieces.collect():
        whole[r["conv_id"]][r["piece"]] = r["formatted"]
        assert all(r["formatted"].startswith(chat._END, e["end"]) for e in r["learned"])
    assert (max(map(len, whole.values())) > 1) == (longest == 50)
    for parts in whole.values():
        assert sorted(parts) == list(range(len(parts)))
        assert chat.parse("".join(parts[i] for i in range(len(parts)))) is not None
    empty = spark.createDataFrame([], TALK)
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


def test_only_what_conflicts_is_escaped():
    assert chat.render("user", "a \\ b # c </turn")[0] == "### User: a \\ b # c </turn\n</turn>\n"
    assert chat.render("user", chat.TRIAL)[0] == "### User: \\\\### Assistant: \\</turn> ok\n</turn>\n"
    for bad in ("### User: open", "text", "### User: a </turn>\n", "### User: ### \n</turn>\n", "### Nobody: a\n</turn>\n", '### "\\x": a\n</turn>\n'):
        assert chat.parse(bad) is None
