"""Long repeated spans of words, by a compacted de Bruijn graph.

The k-mers of words (windows of ``K``) are the edges of the graph, each between
its first and its last k - 1 words. A document is cut into runs of neighbouring
edges that share their least sub-window (minimizer), which depends on the words
alone: equal k-mers always have equal minimizers, wherever they stand. A run is
a path without a branch inside one text. Runs whose minimizer occurs once cannot
hold a repeated edge and go at once. Equal runs are compacted to one path with
its first source coordinate, by a grouping, and a join tells every run its path;
only where a minimizer has several paths, that is, where the graph branches, are
single edges looked up, by 128 bits of their sequence. Repeated runs and edges
that go on along the same source are then compacted to long spans, and the words
of each span are compared with those at its source's coordinates.

Keys that very many rows share are looked up in a broadcast table of at most
``MOST_HOT`` of them, so that no task gets all rows of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_words, known_id, null_id_back, saved, sequence_hashes, utf8_column

K = 20
#: Words of a sub-window.
SUB = 8
#: Keys that are looked up by broadcast at most, and the rows that such a key has at least.
MOST_HOT, LEAST_HOT = 4096, 1000
#: Slices of one document that are looked at together.
SLICES = 4096


def _minimizer_runs(words: np.ndarray, offsets: np.ndarray, k: int, sub: int) -> tuple[np.ndarray, ...]:
    """The runs of all rows: row, first k-mer (within the row), number of k-mers, minimizer, hash of the sequence."""
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < k:
        return empty, empty, empty, empty, empty
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.arange(n - sub + 1)
    value, _ = sequence_hashes(words, ends, ends + sub)
    place = np.arange(len(value))
    width = 1
    while width < k - sub + 1:  # the least value of ever more neighbours, the leftmost of equal ones
        step = min(width, k - sub + 1 - width)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        width += step
    whole = row[: n - k + 1] == row[k - 1 :]
    begins = whole.copy()
    begins[1:] &= (place[1:] != place[:-1]) | (row[1 : n - k + 1] != row[: n - k]) | ~whole[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return empty, empty, empty, empty, empty
    # a run ends before the next one, or before the k-mers that reach into the next row
    count = np.diff(np.append(start, n - k + 1))
    count = np.minimum(count, offsets[row[start] + 1] - k + 1 - start)
    content, _ = sequence_hashes(words, start, start + count + k - 1)
    return row[start], start - offsets[row[start]], count, value[start].view(np.int64), content.view(np.int64)


def _blocks(batch, rows: int = 512) -> Iterator:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _runs(docs: DataFrame, k: int, sub: int, places: bool) -> DataFrame:
    """docs (doc, th, text) to rows (minimizer, content, doc, th, place) or, without places, to (minimizer, n)."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in _blocks(batch):
                words, offsets = hashed_words(*utf8_column(block.column("text")))
                row, start, count, minimizer, content = _minimizer_runs(words, offsets, k, sub)
                if places:
                    doc, th = (block.column(x).to_numpy(zero_copy_only=False)[row] for x in ("doc", "th"))
                    columns = [minimizer, content, doc, th, (start << 6) | count]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["minimizer", "content", "doc", "th", "place"])
                else:
                    value, times = np.unique(minimizer, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], ["minimizer", "n"])

    schema = "minimizer long, content long, doc long, th long, place long" if places else "minimizer long, n long"
    return docs.select("doc", "th", "text").mapInArrow(cut, schema)


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows whose keys are in the saved ``table`` (keys, value, copies), with its value.

    A key with more than a ``MOST_HOT``-th of all copies is found by broadcast;
    its rows then travel under keys of their own.
    """
    copies = F.col("copies")
    bound = max(LEAST_HOT, (table.agg(F.sum(copies)).first()[0] or 0) // MOST_HOT)  # fewer than MOST_HOT keys are above it
    hot = table.where(copies > bound).select(*keys, F.col(value).alias("hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    spread = F.when(F.col("hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64("doc", "th", "start"))
    found = marked.withColumn(keys[0], spread).join(table.where(copies <= bound).select(*keys, value), keys, "left")
    return found.withColumn(value, F.coalesce("hot", value)).drop("hot").where(F.col(value).isNotNull())


def repeated_spans(docs: DataFrame, k: int = K, sub: int = SUB) -> DataFrame:
    """All k-mers that also start earlier, as spans: doc, th, start (word), n (k-mers), source_doc, source_th, source_start.

    docs: doc (a long), th (64 bits of a hash of the text, which tell rows that
    repeat a doc apart), text. Earlier is a smaller doc, or the same one and
    an earlier start. The source is the first occurrence of the span's words, or,
    where that is shared, of the k-mers that it was compacted from.
    """
    if k - sub + 1 >= 64 or sub > k:
        raise ValueError("k - sub must be from 0 to 62")
    counts = _runs(docs, k, sub, False).groupBy("minimizer").agg(F.sum("n").alias("n"))
    repeated = saved(counts.where("n > 1").select("minimizer"))
    runs = saved(_runs(docs, k, sub, True).join(repeated, "minimizer", "left_semi"))
    start, n = F.shiftrightunsigned("place", 6), F.expr("place & 63")
    runs = runs.select("minimizer", "content", "doc", start.alias("start"), n.alias("n"), "th")
    paths = saved(runs.groupBy("minimizer", "content").agg(F.min(F.struct("doc", "start", "th", "n")).alias("first"), F.count("*").alias("copies")))
    later = F.struct("doc", "start") > F.struct(F.col("first.doc"), F.col("first.start"))
    source = [F.col("first.doc").alias("source_doc"), F.col("first.th").alias("source_th"), F.col("first.start").alias("source_start")]
    branching = saved(paths.groupBy("minimizer").agg(F.count("*").alias("paths")).where("paths > 1").select("minimizer"))
    heads = paths.join(branching, "minimizer", "left_semi")
    copies = _looked_up(runs, paths.where("copies > 1"), ["minimizer", "content"], "first").where(later).select("doc", "th", "start", "n", *source)

    heads = heads.select("first.*").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # as long as one document at most

    def windows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in _blocks(batch):
                words, offsets = hashed_words(*utf8_column(block.column("text")))
                lists = block.column("runs")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                runs = lists.flatten()
                row = np.repeat(np.arange(block.num_rows), sizes)
                begin, count = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row, begin = np.repeat(row, count), np.repeat(begin, count)
                begin = begin + np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
                at = offsets[row] + begin
                one, two = sequence_hashes(words, at, at + k)
                doc, th = (block.column(x).to_numpy(zero_copy_only=False)[row] for x in ("doc", "th"))
                columns = [one.view(np.int64), two.view(np.int64), doc, th, begin]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["one", "two", "doc", "th", "start"])

    edges = saved(docs.join(heads, ["doc", "th"]).select("doc", "th", "text", "runs").mapInArrow(windows, "one long, two long, doc long, th long, start long"))
    firsts = saved(edges.groupBy("one", "two").agg(F.min(F.struct("doc", "start", "th")).alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    single = _looked_up(edges, firsts, ["one", "two"], "first").where(later).select("doc", "th", "start", F.lit(1).cast("long").alias("n"), *source)
    # rows that repeat bring the same spans: one of each goes on
    return saved(_compacted(copies.unionByName(single).distinct()))


def _compacted(spans: DataFrame) -> DataFrame:
    """Spans of one text that follow one another along the same source become one."""
    along = ["doc", "th", "source_doc", "source_th", "diagonal"]
    spans = spans.withColumn("diagonal", F.col("start") - F.col("source_start")).repartition("doc", "th")
    before = Window.partitionBy(*along).orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))
    islands = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*along, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"))
    return merged.select("doc", "th", "start", (F.col("stop") - F.col("start")).alias("n"), "source_doc", "source_th", (F.col("start") - F.col("diagonal")).alias("source_start"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _with_source_words(spans: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The spans with ``words``: the SHA-256 of the words at their source's coordinates."""
    place = ["source_doc", "source_th", "source_start", "n"]
    slices = spans.groupBy(*place).agg(F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("source_doc", "source_th").orderBy("source_start", "n"))
    grouped = slices.withColumn("part", F.floor((nth - 1) / SLICES)).groupBy(F.col("source_doc").alias("doc"), F.col("source_th").alias("th"), "part")
    grouped = grouped.agg(F.collect_list(F.struct("source_start", "n", "copies")).alias("slices"))

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in _blocks(batch):
                out: list[list] = [[], [], [], [], [], []]
                for doc, th, text, slices in zip(*(block.column(c).to_pylist() for c in ("doc", "th", "text", "slices")), strict=True):
                    words = text.encode().split()
                    for s in slices:
                        at, n = s["source_start"], s["n"]
                        for column, value in zip(out, (doc, th, at, n, s["copies"], _digest(words[at : at + n + k - 1])), strict=True):
                            column.append(value)
                kinds = *[pa.int64()] * 5, pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [*place, "copies", "words"])

    # rows that are alike in doc and th have equal texts: either serves as the source
    texts = docs.join(grouped, ["doc", "th"]).select("doc", "th", "text", "slices")
    found = texts.mapInArrow(digests, "source_doc long, source_th long, source_start long, n long, copies long, words binary")
    found = saved(found.groupBy(*place).agg(F.max("copies").alias("copies"), F.first("words").alias("words")))
    return _looked_up(spans, found, place, "words")


def remove_repeats(docs: DataFrame, k: int = K, sub: int = SUB, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a k-mer that also starts earlier: doc_id, n_words, n_removed, kept, kept_sha256.

    Earlier means a smaller doc_id, or the same one and an earlier start; k-mers
    are judged on the input. kept has the words that stay, joined by one space,
    or is the text as it was where nothing is removed; kept_sha256 is that of the
    kept words joined by one space, in UTF-8 and lowercase hexadecimal digits.

    A null text has no words (kept is null), an empty one neither. A null doc_id
    comes before all others. Rows that repeat a doc_id each get a row: those with
    equal texts are not earlier than one another and fare alike; of those with
    different texts a k-mer is repeated if it starts later in its text than in
    another. Texts of fewer than k words stay. An empty table gives no rows. Only
    doc_id, text and the columns of ``carry``, which follow unchanged, are read.
    """
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("rest")] if carry else []
    full = docs.select(known_id("doc_id").alias("doc"), F.col("text").cast("string").alias("text"), *rest)
    th = F.xxhash64("text").alias("th")
    # the columns' order is that of repeated_spans, so that Spark deals the texts out once for both
    full = full.select("doc", th, "text", *(["rest"] if carry else []))
    texts = full.select("doc", "th", "text")
    spans = _with_source_words(repeated_spans(texts, k, sub), texts, k)
    spans = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n", "words")).alias("spans"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in _blocks(batch):
                out: list[list] = [[], [], [], []]
                for text, spans in zip(block.column("text"), block.column("spans"), strict=True):
                    text = text.as_py()
                    words = kept = (text or "").encode().split()
                    if spans.is_valid and len(spans.values):
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        for span in spans.as_py():
                            at, end = span["start"], span["start"] + span["n"] + k - 1
                            if _digest(words[at:end]) != span["words"]:
                                raise RuntimeError("a span differs from the words at its source: two runs of words share their hashes")
                            edges[at] += 1
                            edges[end] -= 1
                        stay = np.cumsum(edges)[:-1] == 0
                        kept = [words[i] for i in np.flatnonzero(stay)]
                    joined = b" ".join(kept)
                    values = len(words), len(words) - len(kept), text if len(kept) == len(words) else joined.decode(), hashlib.sha256(joined).hexdigest()
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
                made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column(c) for c in same] + made, [*same, "n_words", "n_removed", "kept", "kept_sha256"])

    same = ["doc", "rest"] if carry else ["doc"]
    joined = full.join(spans, ["doc", "th"], "left").select("text", "spans", *same)
    made = T.StructType.fromDDL("n_words long, n_removed long, kept string, kept_sha256 string")
    cut_rows = joined.mapInArrow(cut, T.StructType([full.schema[c] for c in same] + made.fields))
    carried = [F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)]
    return cut_rows.select(null_id_back("doc").alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256", *carried)


SQL = """
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
kmers AS (
    SELECT doc_id, start, array_to_string(words[start + 1 : start + 20], ' ') AS kmer
    FROM (SELECT doc_id, words, unnest(range(0, greatest(0, len(words) - 19))) AS start FROM docs)),
later AS (
    SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY kmer ORDER BY doc_id, start) AS nth FROM kmers) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, start + i AS word FROM later, range(0, 20) AS r(i)),
each AS (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS word FROM docs),
stays AS (
    SELECT e.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY e.word) AS kept
    FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.word = g.word WHERE g.doc_id IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(d.words)::bigint AS n_words, (len(d.words) - coalesce(s.n, 0))::bigint AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN stays s ON d.doc_id = s.doc_id"""
