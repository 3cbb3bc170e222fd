"""SimHash near-duplicates by multi-index hashing.

The 64 bits are cut into two segments. If two fingerprints differ in at most 3
bits, they differ in at most 1 bit in one segment: each fingerprint stands in
two tables by its segments, and is looked up under every value of a segment's
Hamming ball of radius 1. A bucket with few fingerprints gives candidate pairs,
whose complete distances are verified; one with many is linked without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import known_id, null_id_back, saved, shuffled
from .components import connected

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENT = 32
#: Buckets with more fingerprints than this are linked by Hamming balls of the other segment instead of by pairs.
PAIRS_UP_TO = 64

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)  # byte value, bit


def _majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes (``counts`` long) the bits that are set in over half of it."""
    rows = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts), dtype=np.uint64)
    for k in range(8):
        byte = (hashes >> np.uint64(8 * k)).astype(np.uint8)
        seen = np.bincount(rows * 256 + byte, minlength=len(counts) * 256).reshape(-1, 256)
        bits = 2 * (seen.astype(np.float64) @ _BIT) > counts[:, None]
        out |= (bits @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (a long with the 64 bits) of every document, then the columns of ``carry``.

    Words of the text with A-Z lower-cased; shingles of ``shingle`` words joined
    by a space, repeats included, hashed by XXH64. A text with fewer words has
    one shingle, all of them; one without words, or a null text, has fingerprint
    zero. Whole texts are read, in blocks of a bounded number of shingles unless
    one text alone has more.
    """

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest as xxh64

        for batch in batches:
            counts, hashes, done = [], [], []

            def close() -> None:
                if counts:
                    done.append(_majorities(np.array(hashes, dtype=np.uint64), np.array(counts)))
                counts.clear()
                hashes.clear()

            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                if len(words) <= shingle:
                    found = [xxh64(b" ".join(words), seed)] if words else []
                else:
                    found = [xxh64(b" ".join(x), seed) for x in zip(*[words[i:] for i in range(shingle)], strict=False)]
                counts.append(len(found))
                hashes += found
                if len(hashes) > 200_000 or len(counts) >= 1024:
                    close()
            close()
            fp = np.concatenate(done).view(np.int64) if done else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", *carry])

    made = T.StructType.fromDDL("doc_id long, fp long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry).mapInArrow(hashed, T.StructType(made.fields + [docs.schema[c] for c in carry]))


def links(distinct: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links a, b between fingerprints of ``distinct`` (column fp) that join just those that chains of close ones join.

    Every pair that differs in at most 3 bits is linked, or both of it are linked
    to one more fingerprint that is as close to each. No table is broadcast: the
    probes are many times the file that they come from, by which Spark judges.
    """
    low = F.col("fp").bitwiseAND(F.lit(2**SEGMENT - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    tables = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key"), high.alias("other")), F.struct(F.lit(1).alias("seg"), high.alias("key"), low.alias("other")))
    index = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.seg", "t.key", "t.other")
    sizes = index.groupBy("seg", "key").agg(F.count("*").alias("n"))
    # looked up: the segment itself, and the segment without one of its bits; of two values one bit apart, one finds the other
    ball = F.expr(f"concat(array(struct(key, 0 as off)), transform(filter(sequence(0, {SEGMENT - 1}), i -> (shiftrightunsigned(key, i) & 1) = 1), i -> struct(key ^ shiftleft(1L, i) as key, 1 as off)))")
    probes = index.select("fp", "seg", F.col("key").alias("own"), F.explode(ball).alias("p")).select("fp", "seg", "own", "p.key", "p.off")

    few = probes.alias("a").join(shuffled(index.join(shuffled(sizes.where(F.col("n") <= pairs_up_to)), ["seg", "key"])).alias("b"), ["seg", "key"])
    far = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    few = few.where((F.col("a.fp") != F.col("b.fp")) & (far <= MOST_BITS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    # Within a large bucket, those looked up meet those that stand in it through values of the other segment: b stands
    # for all values within 1 bit of its own, a for all within what is left of the distance less 1; they share a value
    # if and only if they are close enough. Each value then needs one link from each a to one of its b.
    large = sizes.where(F.col("n") > pairs_up_to).select("seg", "key")
    one = f"transform(sequence(0, {SEGMENT - 1}), i -> shiftleft(1L, i))"
    within1 = f"concat(array(0L), {one})"
    within2 = f"concat(array(0L), {one}, flatten(transform(sequence(1, {SEGMENT - 1}), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
    standing = index.join(shuffled(large), ["seg", "key"]).select("fp", "seg", "key", "other", F.explode(F.expr(within1)).alias("flip"))
    standing = standing.groupBy("seg", "key", F.col("other").bitwiseXOR(F.col("flip")).alias("value")).agg(F.min("fp").alias("b"))
    other = F.when(F.col("seg") == 0, high).otherwise(low)
    flips = F.when(F.col("off") == 0, F.expr(within2)).otherwise(F.expr(within1))
    asked = probes.join(shuffled(large), ["seg", "key"]).select("fp", "seg", "key", other.alias("other"), F.explode(flips).alias("flip"))
    asked = asked.select(F.col("fp").alias("a"), "seg", "key", F.col("other").bitwiseXOR(F.col("flip")).alias("value"))
    many = asked.join(shuffled(standing), ["seg", "key", "value"]).where("a <> b").select("a", "b")
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document.

    Documents link if their fingerprints differ in at most 3 bits; component_id
    is the smallest doc_id that links reach, the document's own included. Rows
    that repeat a doc_id each get a row. A null doc_id counts as smaller than all
    others and as one document; where it is the smallest, component_id is null.
    Ties do not occur. An empty table gives no rows. Only doc_id and text are read.
    """
    prints = saved(fingerprints(docs).select(known_id("doc_id").alias("doc_id"), "fp"))
    first = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(first.select(F.col("fp").alias("node"), "least"), links(first.select("fp")))
    out = prints.join(shuffled(labels.withColumnRenamed("node", "fp")), "fp")
    return out.select(null_id_back("doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), null_id_back("least").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """doc (a long, ``NULL_ID`` for null) and th (``xxhash64`` of the text) of one row of each group of near-duplicates.

    Groups are those of ``near_duplicates``, told apart by their fingerprints: the
    row is the one with the smallest doc_id of the group and, of rows that share
    that, with the smallest th. Only exact copies under one doc_id share both.
    """
    prints = fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), carry=("th",)).select(F.col("fp").alias("node"), F.struct(known_id("doc_id").alias("doc"), "th").alias("row"))
    first = saved(prints.groupBy("node").agg(F.min("row").alias("least")))
    labels = connected(first, links(first.select(F.col("node").alias("fp"))))
    return labels.select("least.doc", "least.th").distinct()
