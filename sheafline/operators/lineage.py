"""Cutting the lineage of a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Whether Spark removes the shuffle files of a query when that query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if all of Spark runs on this machine. On a cluster this raises."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="sheafline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/sheafline/{uuid.uuid4().hex}"


def shuffled(rows: DataFrame) -> DataFrame:
    """The rows for a join that must not send them through the driver: Spark judges by the file, which may be far smaller than what is made of it."""
    return rows.hint("merge")


def _storable(kind: T.DataType) -> bool:
    """Whether a file can hold the type as it is."""
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        return len(set(names)) == len(names) > 0 and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.UserDefinedType))


def cut(rows: DataFrame) -> DataFrame:
    """The rows, worked out once and kept in the shared folder, so that a lost executor loses nothing.

    They are written as a compressed table, and the shuffle files of the write go when it has ended: nothing reads them any
    more. A checkpoint would be worked out twice and stored as plain rows; it stands in only for types that a table cannot hold.
    """
    spark = rows.sparkSession
    if not _storable(rows.schema):
        shared_folder(spark)
        return rows.checkpoint()
    path = fresh_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
