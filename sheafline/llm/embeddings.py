"""Near-duplicate embeddings by cross-polytope hashing.

A table's hash is made of ``hashes`` parts. For each, a vector is turned by
three rounds of random signs and a fast Hadamard transform, and the nearest of
the vectors +-e_i is its part. Besides its own bucket a vector enters those in
which the part that was decided most narrowly takes its second choice. Whatever
two vectors share a bucket are a candidate pair; its cosine is verified.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import known_id, null_id_back, saved
from .components import connected

THRESHOLD = 0.95
#: Buckets that a vector enters in each table.
PROBES = 2
#: Vectors that share a bucket on average, beyond near-duplicates; more tables and longer hashes are taken as the input grows.
#: Below 1, most entries of vectors without near-duplicates are alone in their bucket, and no vector is sent there.
BUCKET = 1 / 8
#: Vectors of a bucket that one comparison holds; a larger bucket is compared block against block.
BLOCK = 512
SEED = 42
#: The share of pairs just at the threshold that all tables may miss; closer pairs are missed far less.
MISS = 0.005
#: Pairs at the threshold on which the chance to share a bucket of one table is measured, and tables that are tried for that.
TRIED_PAIRS, TRIED_TABLES = 1000, 4


def plan_tables(vectors: int, dimension: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Parts of a hash, so that there are about vectors / BUCKET buckets, and tables, so that at most MISS of the pairs at the threshold share none."""
    hashes = max(1, math.ceil(math.log(max(2.0, vectors / BUCKET)) / math.log(2 * dimension)))
    return hashes, max(4, math.ceil(math.log(MISS) / math.log(1 - chance_to_meet(dimension, hashes, threshold))))


@functools.cache
def chance_to_meet(dimension: int, hashes: int, threshold: float) -> float:
    """The share of tables in which two random unit vectors of cosine ``threshold`` have a bucket in common, by trial: the same on every machine, and of no data."""
    if dimension == 1:
        return 0.999
    random = np.random.default_rng([SEED, dimension, hashes])
    one, other = random.normal(size=(2, TRIED_PAIRS, dimension))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other *= math.sqrt(max(0.0, 1 - threshold * threshold)) / np.linalg.norm(other, axis=1, keepdims=True)
    both = [bucket_codes(x, hashes, TRIED_TABLES, seed=SEED + 1).reshape(TRIED_PAIRS, TRIED_TABLES, -1) for x in (one, threshold * one + other)]
    met = (both[0][:, :, :, None] == both[1][:, :, None, :]).any(axis=(2, 3))
    return min(0.999, max(0.01, float(met.mean())))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, in ``x`` itself."""
    n, width = x.shape
    h = 1
    while h < width:
        part = x.reshape(n, width // (2 * h), 2, h)
        first = part[:, :, 0] - part[:, :, 1]
        part[:, :, 0] += part[:, :, 1]
        part[:, :, 1] = first
        h *= 2
    x /= math.sqrt(width)
    return x


def bucket_codes(vectors: np.ndarray, hashes: int, tables: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """The 64-bit codes of the ``tables * probes`` buckets of each row, a table's after the ones before."""
    n, dimension = vectors.shape
    width = 1 << max(1, (dimension - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dimension] = vectors
    random = np.random.default_rng([seed, dimension])
    every = np.arange(n)
    codes = np.zeros((n, tables, probes), dtype=np.uint64)
    for t in range(tables):
        choice, gaps = np.zeros((2, hashes, n), dtype=np.uint64), np.zeros((hashes, n))
        for k in range(hashes):
            x = padded
            for _ in range(3):
                x = _hadamard(x * random.choice([-1.0, 1.0], width))
            size = np.abs(x)
            for place in range(2):
                top = size.argmax(axis=1)
                choice[place, k] = 2 * top + (x[every, top] < 0)
                gaps[k] = size[every, top] - gaps[k] if place == 0 else gaps[k] - size[every, top]
                size[every, top] = -1
        order = np.argsort(gaps, axis=0)
        for p in range(probes):
            code = np.full(n, t * 1_000_003 + dimension, dtype=np.uint64)
            for k in range(hashes):
                second = (p > 0) & (order[min(p, hashes) - 1] == k)
                code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(second, choice[1, k], choice[0, k]) + np.uint64(1)
            codes[:, t, p] = code ^ (code >> np.uint64(31))
    return codes.reshape(n, tables * probes)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _met_before(before: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair share one of their earlier buckets."""
    codes, column, occur = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(before)), [len(x) for x in before])
    common = occur > 1
    use = common[column]
    member = np.zeros((len(before), int(common.sum())), dtype=np.float32)
    member[row[use], (np.cumsum(common) - 1)[column[use]]] = 1
    return (member @ member.T)[a, b] > 0


def _compare(vectors: np.ndarray, before: list[np.ndarray], copies: np.ndarray, block: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one bucket that link to others which they met in no earlier one, how many those are with their copies, and a row that stands for the chain.

    across: the rows are two blocks of a large bucket, and only pairs of one row from each count.
    """
    unit = _unit(vectors)
    close = unit @ unit.T >= threshold
    if across:
        close &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(close, 1))
    counted = np.zeros(len(unit), dtype=np.int64)
    label = np.arange(len(unit))
    if len(a):
        new = ~_met_before(before, a, b)
        a, b = a[new], b[new]
        np.add.at(counted, a, copies[b])
        np.add.at(counted, b, copies[a])
        while len(a):
            last = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == last).all():
                break
    linked = np.flatnonzero(counted)
    return linked, counted[linked], label[linked]


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row with columns vec_id and embedding.

    Two rows link if the cosine of their vectors, in double precision, is at
    least ``threshold`` and they share a bucket. n_links counts the other rows
    linked directly, component_id is the smallest vec_id that links reach, the
    row's own included, and kept says that it is its own. Equal vectors are hashed
    and compared once and count as many times as they occur.

    A vector that is null, empty, zero or has a null or non-finite component links
    with nothing, not even its copies; vectors of different lengths do not link. A
    null vec_id counts as smaller than all others. Rows that repeat a vec_id each
    get a row and count as others of one another. An empty table gives no rows.
    """
    single = table.schema["embedding"].dataType == T.ArrayType(T.FloatType(), table.schema["embedding"].dataType.containsNull)
    kind, number = ("float", np.float32) if single else ("double", np.float64)
    rows = table.select(known_id("vec_id").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    biggest = F.array_max(F.transform("v", F.abs))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (biggest > 0)
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    rows = rows.withColumn("node", F.unhex(F.md5(F.encode(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), "utf-8"))))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["node", "least", "copies"]].assign(vector=[np.asarray(v, dtype=number).tobytes() for v in batch["v"]])

    nodes = saved(nodes.mapInPandas(as_bytes, "node binary, least long, copies long, vector binary"))
    count = nodes.count()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["vector"].str.len()):
                dimension = size // number().itemsize
                hashes, tables = plan_tables(count, dimension, threshold)
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    codes = bucket_codes(_unit(np.frombuffer(b"".join(some["vector"]), dtype=number).reshape(len(some), dimension)), hashes, tables).view(np.int64)
                    yield pd.DataFrame({"node": some["node"], "codes": list(codes)})

    codes = saved(nodes.select("node", "vector").mapInPandas(hashed, "node binary, codes array<long>"))
    # nodes go by a short key here; a bucket that it lends a node by chance is not among the node's own codes
    key = F.xxhash64("node")
    entered = codes.select(key.alias("key"), F.explode(F.array_distinct("codes")).alias("code"))
    shared = entered.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(entered.join(shared, "code").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("code", "n"))).alias("buckets")))
    whole = nodes.join(codes, "node").withColumn("key", key).join(shared, "key")
    whole = whole.withColumn("buckets", F.filter("buckets", lambda x: F.array_contains("codes", x["code"])))
    at = F.posexplode("buckets").alias("place", "bucket")
    entries = whole.select("node", "copies", "vector", F.col("buckets.code").alias("own"), at)
    blocks = F.ceil(F.col("bucket.n") / F.lit(BLOCK)).cast("int")
    entries = entries.select("node", "copies", "vector", F.slice("own", F.lit(1), F.col("place")).alias("before"), "bucket.code", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int").alias("block"))
    # a bucket's blocks meet in pairs; each row goes to the pairs that its block is in
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("first"), F.greatest("block", j).alias("second")))
    entries = entries.withColumn("pair", F.explode(others))
    group = ["code", "size", "first", "second"]
    meet = entries.select("node", "copies", "vector", "before", "block", "code", F.length("vector").alias("size"), "pair.first", "pair.second").repartition(*group).sortWithinPartitions(*group)

    def links_of(done: pd.DataFrame) -> Iterator[pd.DataFrame]:
        changes = (done[group].to_numpy()[1:] != done[group].to_numpy()[:-1]).any(axis=1)
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(done)]
        node, vector, before = done["node"].to_numpy(), done["vector"].to_numpy(), done["before"].to_numpy()
        copies, block, across = done["copies"].to_numpy(), done["block"].to_numpy(), (done["first"] != done["second"]).to_numpy()
        found = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                vectors = np.frombuffer(b"".join(vector[lo:hi]), dtype=number).reshape(hi - lo, -1)
                linked, n, to = _compare(vectors, list(before[lo:hi]), copies[lo:hi], block[lo:hi], across[lo], threshold)
                if len(linked):
                    found.append((node[lo + linked], n, node[lo + to]))
        if found:
            yield pd.DataFrame({"node": np.concatenate([f[0] for f in found]), "n": np.concatenate([f[1] for f in found]), "to": np.concatenate([f[2] for f in found])})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = (batch[group] == batch[group].iloc[-1]).all(axis=1)
            kept = batch[last]
            yield from links_of(batch[~last])
        if kept is not None:
            yield from links_of(kept)

    links = saved(meet.mapInPandas(compared, "node binary, n long, to binary"))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected(nodes.select("node", "least"), links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    about = labels.join(nodes.select("node", "copies"), "node").join(counts, "node", "left")
    about = saved(about.select("node", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    out = rows.select("vec_id", "node").join(about, "node", "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        null_id_back("vec_id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != -(2**63), component).alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )


#: The exact result by brute force, which the buckets must reach.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
    SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN least ON v.vec_id = least.x LEFT JOIN counts ON v.vec_id = counts.x"""
