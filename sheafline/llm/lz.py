"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed into the phrases of a growing dictionary: each phrase is the
longest known one and the character after it. The set of phrases is hashed, and
the smallest hash in each of ``BINS`` bins is the signature; two signatures
agree in about as many bins as the phrase sets have in common.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_slices, known_id, saved

BINS = 128
#: Hexadecimal digits of a bin in the fingerprint.
DIGITS = 4
#: Ranges of documents for each task, and rows drawn for each range to find its bounds.
SPREAD, SAMPLED = 16, 32


def parse(data: bytes, known: dict[int, int], node: int = 0) -> tuple[list[int], list[int], int]:
    """Parse ``data`` into phrases, adding them to the tree ``known``.

    A phrase is a node; ``known`` leads from node * 256 + byte to the next one.
    Parsing goes on from ``node``, an unfinished phrase. Returns where in the
    data phrases end, the keys that were added, and the node that is reached.
    """
    ends, keys = [], []
    fresh, get = len(known) + 1, known.get
    for at, byte in enumerate(data, 1):
        key = node << 8 | byte
        node = get(key, 0)
        if not node:
            known[key] = fresh
            fresh += 1
            keys.append(key)
            ends.append(at)
    return ends, keys, node


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest hash in each bin; an empty bin takes that of the next full one to its right. 64-bit hashes in, 16-bit values out; no hash: all zero."""
    if not len(hashes):
        return np.zeros(bins, dtype=np.uint16)
    ordered = np.sort(hashes)
    own, first = np.unique(ordered >> np.uint64(64 - bins.bit_length() + 1), return_index=True)
    values = ((ordered[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    return values[np.searchsorted(own, np.arange(bins)) % len(own)]


def _hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def _hashes(data: bytes, ends: list[int]) -> np.ndarray:
    stops = np.array(ends, dtype=np.int64)
    return hashed_slices(np.frombuffer(data, np.uint8), np.concatenate([np.zeros(min(1, len(stops)), np.int64), stops[:-1]]), stops)


def both_fingerprints(head: str, tail: str, other_tail: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of head + tail and of head + other_tail; the head is parsed once.

    Characters are parsed as UTF-8. What is left at the end of a text is a known
    phrase already and adds none.
    """
    start, known = head.encode(), {}
    ends, _, node = parse(start, known)
    common = _hashes(start, ends)
    begun = start[ends[-1] if ends else 0 :]

    def close(more: str) -> np.ndarray:
        data = more.encode()
        stops, keys, _ = parse(data, known, node)
        for key in keys:
            del known[key]
        return signature(np.unique(np.concatenate([common, _hashes(begun + data, [len(begun) + x for x in stops])])))

    return close(tail), None if other_tail is None else close(other_tail)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """The share of bins that agree; an empty text is like an empty one only."""
    return float(a_empty and b_empty) if a_empty or b_empty else float((a == b).mean())


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    # one literal, whatever the number of bounds
    known = F.from_json(F.lit(json.dumps([dict(zip(("id", "th", "salt"), bound, strict=True)) for bound in bounds])), "array<struct<id:long,th:long,salt:long>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) <= key), at + step).otherwise(at))


def fingerprints_with_next(docs: DataFrame, parts: int | None = None, stored: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many of the next document's (all, if it has fewer). Next is the next
    smaller doc_id; the smallest is followed by the largest. Rows that share a
    doc_id are ordered by a hash of their texts, the larger first, and equal rows
    by their places in the table; a null doc_id comes after all others. A null
    text is empty: it has the fingerprint of no phrase, and is like another empty
    text only. With one row, it is its own next. An empty table gives no rows. Only
    doc_id and text are read.

    Rows are told apart by their places in the files of a Parquet table: stored
    says that docs is read straight from one; else it is written to one. They go to
    ``SPREAD`` ranges of (doc_id, hash, place) for each of ``parts`` tasks, with
    bounds from a sample, so neither a repeated id nor a repeated row gathers in one
    range; each range also gets the first row of the range after it, and is read
    in order as a stream.
    """
    import hashlib

    spark = docs.sparkSession
    docs = docs.select("*") if stored else saved(docs.select("doc_id", "text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(known_id("doc_id").alias("id"), F.xxhash64(text).alias("th"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("salt"), text.alias("text"))
    key = F.struct("id", "th", "salt")
    ranges = SPREAD * parts
    # the rows with small hashed places are a sample whose size depends on the number of ranges alone, on average
    below = min(2**63 - 1, SAMPLED * ranges * 2**64 // max(1, docs.count()) - 2**63)
    drawn = sorted(tuple(r) for r in rows.where(F.xxhash64("salt") <= below).select("id", "th", "salt").collect())
    bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    # a range's number counts from the largest ids down, so that the numbers go up in the order of the documents
    ranged = rows.withColumn("part", F.lit(len(bounds)) - _range_of(key, bounds)).withColumn("edge", F.lit(False))
    tops = ranged.groupBy("part").agg(F.max(key).alias("top")).orderBy("part").collect()  # a row for each range
    if tops:
        to = spark.createDataFrame([(*tops[i]["top"], tops[i - 1]["part"]) for i in range(len(tops))], "id long, th long, salt long, part int")
        edges = rows.join(F.broadcast(to), ["id", "th", "salt"]).select("id", "th", "salt", "text", "part", F.lit(True).alias("edge"))
        ranged = ranged.unionByName(edges)
    ranged = ranged.repartition(parts, "part").sortWithinPartitions("part", "edge", F.desc("id"), F.desc("th"), F.desc("salt"))
    ranged = ranged.select("part", "id", "text", "edge")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # a document whose next one is not yet known
        open_row = None  # a document whose next one is known, but not yet that one's fingerprint
        for batch in batches:
            out = []
            for part, doc_id, text, edge in zip(batch["part"], batch["id"], batch["text"], batch["edge"], strict=True):
                if waiting is not None and waiting[0] == part:
                    own_text = waiting[2]
                    cut = len(own_text) - len(own_text) // 3
                    more = text[: len(own_text) // 3]
                    own, edited = both_fingerprints(own_text[:cut], own_text[cut:], more)
                    if open_row is not None:
                        out.append((*open_row[0], likeness(open_row[1], own, open_row[2], not own_text)))
                    changed = own_text[:cut] + more
                    row = (waiting[1], len(own_text), hashlib.sha256(changed.encode()).hexdigest(), _hex(own), _hex(edited), likeness(own, edited, not own_text, not changed))
                    open_row = (row, own, not own_text)
                if edge:
                    if open_row is not None:
                        last, _ = both_fingerprints(text, "", None)
                        out.append((*open_row[0], likeness(open_row[1], last, open_row[2], not text)))
                    waiting = open_row = None
                else:
                    waiting = (part, doc_id, text)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    found = ranged.mapInPandas(judge, _RESULT)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))
