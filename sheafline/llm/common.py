"""What several operators share: the shared scratch folder and hashed words.

Words everywhere in this subpackage are runs of bytes outside 0x20 and
0x09-0x0D; a null text has no words.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: it sorts before every real id.
NULL_ID = -(2**63)
#: Whether Spark removes the shuffle files of a query when that query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new path below the folder in ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a temporary folder
    is made and used for this application if all of Spark runs on this machine,
    as in tests; on a cluster, where executors would not share it, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sheafline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sheafline/{uuid.uuid4().hex}"


def saved(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The shuffle files of the write go when it has ended: nothing reads them any
    more, and whether they are collected before the next stages is left to chance.
    row_group: bytes of a row group, for tables of few large rows; a task holds one when it writes or reads.
    """
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not send it through the driver, however small Spark takes it to be."""
    return df.hint("merge")


def whole_row(df: DataFrame, leaving: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` but those of ``leaving`` as one struct, in which no name can clash with those of an operator."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in leaving])


def known_id(column: str | Column) -> Column:
    """The id as a long, with nulls as ``NULL_ID``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def null_id_back(column: str) -> Column:
    """The reverse of ``known_id``."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_SLAB = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_column(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; a null row is empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def hashed_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices of ``data``, each by its bytes and length alone."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each slice of ``words`` (hashes of words), together 128 bits of its sequence."""
    up, down = _powers_to(len(words) + 1)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix64(words ^ np.uint64(salt)) * up[: len(words)], out=sums[1:])
        out.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, and where each row's words begin.

    fold: A-Z count as a-z. Works through slabs of a few megabytes of whole
    rows, so that the working arrays stay small.
    """
    found, counts = [], np.zeros(len(offsets), dtype=np.int64)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLAB, side="right")) - 1)
        lo, hi = offsets[row], offsets[end]
        if hi > lo:
            part = data[lo:hi]
            inside = ~_SPACE[part]
            cut = np.zeros(hi - lo + 1, dtype=bool)
            cut[offsets[row : end + 1] - lo] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | cut[1:-1]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | cut[1:-1]
            s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            found.append(hashed_slices(_FOLD[part] if fold else part, s, e))
            counts[row + 1 : end + 1] = np.diff(np.searchsorted(s, offsets[row : end + 1] - lo))
        row = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(counts)
