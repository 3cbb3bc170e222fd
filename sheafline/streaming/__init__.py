"""Extensions for streams; the batch operators do not need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_answers(stream: DataFrame, by: str = "row_num") -> DataFrame:
    """The last answer of each qid so far, by ``by``, and whether the qid came more than once: qid, row_num, answer, duplicated.

    stream: qid, answer and ``by``. The state of a qid is its largest (``by``, answer) and a count, kept in the JVM; it lives as
    long as the stream, for a later answer may always come. Of rows that tie in ``by`` the larger answer stands. A null
    qid is one like another. Write it in update mode: a batch brings the qids that changed.
    """
    last = stream.groupBy("qid").agg(F.max(F.struct(F.col(by).alias("row_num"), "answer")).alias("last"), F.count("*").alias("n"))
    return last.select("qid", "last.row_num", "last.answer", (F.col("n") > 1).alias("duplicated"))


def windowed_counts(stream: DataFrame, width: str, lateness: str, *keys: str) -> DataFrame:
    """Counts and sums of value in tumbling windows of ts."""
    counts = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n", "total")


#: The column under which a log keeps the number of the batch that wrote a row.
BATCH = "_batch"


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    """One batch of a stream into a log: written again, it takes the place of what it wrote before.

    Each batch has a folder of its own, and only that is overwritten, so a batch that is retried after a crash in or
    after its write changes nothing.
    """
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={number}")


def append_log(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int, str], None] = write_batch, mode: str = "append", once: bool = False):
    """Write a stream to a log, each batch exactly once; once: what is there now, then stop."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, number: write(rows, number, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log with their batch numbers."""
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)


def latest_of_log(log: DataFrame) -> DataFrame:
    """The answers as they stand after the last batch, from a log of ``latest_answers``: of each qid the row of the highest batch."""
    row = F.struct(*[c for c in log.columns if c != BATCH])
    return log.groupBy("qid").agg(F.max_by(row, BATCH).alias("r")).select("r.*")
