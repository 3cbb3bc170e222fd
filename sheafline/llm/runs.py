"""Periodic runs in the words of documents.

A run is a stretch of words that repeats with a period and that no neighbouring
word extends. All stretches with period q are found from places on a grid: a run
of at least four periods has a stretch of three periods in which each word equals
the one q later, so the grid's places may be three periods apart, and all periods
of a text together have about (n / 3) log n of them. From each place at which the
words agree, the longest common extensions to both sides are searched by halving
steps, on prefix hashes, for all pairs of period and place at once; the words
themselves then confirm what the hashes found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of period and place that are searched at a time, which bounds the working arrays.
PAIRS = 1 << 18

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Prefixes:
    """Prefix hashes of a sequence of numbered words: any two stretches are compared by two lookups each."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, step, np.uint64)])) for step in (_STEP, _STEP_BACK))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def alike(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` from a and from b have the same hash."""
        return (self.sums[a + length] - self.sums[a]) * self.down[a] == (self.sums[b + length] - self.sums[b]) * self.down[b]

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """For each pair a < b, how many words from there on (or, backwards, before there) are the same."""
        known = np.zeros(len(a), np.int64)
        room = len(self.words) - b if forward else a
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            more = known + step
            fits = np.flatnonzero(more <= room)
            back = 0 if forward else more[fits]
            same = self.alike(a[fits] - back, b[fits] - back, more[fits])
            known[fits[same]] += step
            step >>= 1
        return known


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All periods with the places of their grids, in blocks of about ``PAIRS``."""
    longest = n // LEAST_PERIODS
    periods = np.arange(1, longest + 1, dtype=np.int64)
    apart = np.maximum(LEAST_WORDS - periods, (LEAST_PERIODS - 1) * periods)
    counts = np.maximum(0, (n - periods - 1) // apart + 1)
    ends = np.cumsum(counts)
    at = 0
    while at < longest:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        of = np.repeat(np.arange(at, to), counts[at:to])
        first = np.repeat(ends[at:to] - counts[at:to], counts[at:to]) - (ends[at - 1] if at else 0)
        yield periods[of], (np.arange(len(of)) - first) * apart[of]
        at = to


def _confirmed(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether every word of the stretch equals the one a period later, and no neighbour keeps the period."""
    inside = np.array_equal(words[start : end - period], words[start + period : end])
    left = start > 0 and words[start - 1] == words[start - 1 + period]
    right = end < len(words) and words[end] == words[end - period]
    return bool(inside and not left and not right)


def _by_words(words: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """The runs of a period by comparing all words; taken where a hash turned out to be shared by different stretches."""
    same = np.concatenate([[False], words[:-period] == words[period:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return [(int(a), int(b) + period, period) for a, b in edges if b - a + period >= max(LEAST_WORDS, LEAST_PERIODS * period)]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbered words, by start and period.

    A stretch is found with multiples of its period too; the smallest one stands.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    prefixes, found, doubtful = Prefixes(words), [], set()
    for period, place in _grid(n):
        agree = words[place] == words[place + period]
        period, place = period[agree], place[agree]
        end = place + period + prefixes.extension(place, place + period, forward=True)
        start = place - prefixes.extension(place, place + period, forward=False)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], period[long]], axis=1), axis=0))
    if not found:
        return []
    stretches = np.concatenate(found)
    runs, known = [], set()
    for period, end, start in stretches[np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))][:, ::-1].tolist():
        if (start, end) in known:
            continue  # the same stretch with a multiple of its period
        if _confirmed(words, start, end, period):
            runs.append((start, end, period))
            known.add((start, end))
        else:
            doubtful.add(period)
    for period in doubtful:
        runs += _by_words(words, period)
    smallest: dict[tuple[int, int], int] = {}
    for start, end, period in runs:
        smallest[start, end] = min(period, smallest.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in smallest.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


_RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All periodic runs of every text, and the text with each run collapsed to its first period.

    Returns doc_id, n_words, runs (start, length, period; by start, then period)
    and collapsed (the kept words, joined by one space). Words are runs of
    characters outside 0x20 and 0x09-0x0D. A run has its smallest period and at
    least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods.

    A null or empty text has no words and no runs. A null doc_id stays null, and
    rows that repeat a doc_id are read each by itself. An empty table gives no rows.
    Only doc_id and text are read. Nothing is shuffled: a text is one row, and
    the arrays of a text grow with its words times a small constant.
    """

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1):
                words = _WORDS.findall(text.as_py() or "")
                numbers: dict[str, int] = {}
                coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                own = runs_of(coded)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(" ".join(words if not own else [words[i] for i in np.flatnonzero(kept_words(len(words), own))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, f"doc_id long, n_words long, runs {_RUN}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; where the CRC-32 h of the id ends in 0, the text's words repeat with a period from some word on.

    With g = h div 10 and n words, each word i from a = g mod n on is word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id or a text without
    words is left alone.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", hashed.alias("h"), F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.select("doc_id", "text", "words", F.when(n > 0, n).alias("n"), g.alias("g"))
    rows = rows.withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(F.transform("words", place), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` in short: the count, the longest run and digests of all runs and of the collapsed text."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    exponent = F.floor(1000 * length / period)
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The same by islands: for each period that some place of its grid speaks for, all words that equal the one a period
#: later are numbered, and consecutive ones form a stretch. The CRC-32 is worked out from its polynomial.
SQL = r"""
WITH polynomial AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: xor(c >> 8, steps[(xor(c, d) & 255) + 1]))) AS h
    FROM documents, polynomial),
drawn AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS again, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM hashed),
made AS (SELECT doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE words END AS words FROM drawn),
word AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS w FROM made),
period AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM made),
grid AS (SELECT doc_id, q, unnest(range(0, n - q, greatest(6 - q, 3 * q))) AS i FROM period),
spoken AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM grid JOIN word x USING (doc_id, i) JOIN word y ON y.doc_id = x.doc_id AND y.i = x.i + q AND y.w = x.w),
island AS (SELECT doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY doc_id, q ORDER BY x.i) AS of FROM spoken JOIN word x USING (doc_id) JOIN word y ON y.doc_id = spoken.doc_id AND y.i = x.i + q AND y.w = x.w),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, of HAVING count(*) >= greatest(6 - q, 3 * q)),
run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS q FROM stretch GROUP BY ALL),
summed AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'q': q}, {'l': -length, 's': start, 'q': q}) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, i FROM run JOIN word USING (doc_id) WHERE i >= start + q AND i < start + length),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM made LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
