"""Writing documents, answers, histories and reports."""

from __future__ import annotations

import datetime
import hashlib
import json
import subprocess

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import answer_text
from ..operators.graph import EntityGraph
from ..operators.lineage import cut
from ..operators.works import top_row


def documents(rows: DataFrame, path: str) -> None:
    """Records by kind, as JSON."""
    rows.write.mode("overwrite").partitionBy("doc_type").json(path)


def graph(found: EntityGraph, path: str) -> None:
    """The entity graph as JSON below ``path``: a folder for each node table, the edges by kind, both logs, and the counts."""
    for name in ("projects", "clients", "engineers", "documents", "normalizations", "metadata"):
        getattr(found, name).write.mode("overwrite").json(f"{path}/{name}")
    found.edges.write.mode("overwrite").partitionBy("kind").json(f"{path}/edges")
    found.review.write.mode("overwrite").json(f"{path}/needs_review")


def log(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def answers_csv(answers: DataFrame, path: str, by: str = "qid") -> None:
    """question_id, answer, sorted, in files whose order is that of the rows; whole numbers have no point."""
    rows = answers.repartitionByRange(by).sortWithinPartitions(by)
    rows.select(F.col("qid").alias("question_id"), answer_text(F.col("answer")).alias("answer")).write.mode("overwrite").csv(path, header=True)


def upsert(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with new rows in place of those with the same key."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_row(both, [key], [F.desc("_new")]).drop("_new")


#: The column by which an upserted table is partitioned.
BUCKET = "_bucket"


def _with_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))


def create_table(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Writes a table that ``upsert_into`` can change: partitioned by buckets of its key, one row for each key."""
    one = top_row(rows, [key], [F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))])])
    _with_bucket(one, key, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def upsert_into(path: str, new: DataFrame, key: str = "doc_id", order: str | None = None, buckets: int = 256) -> list[int]:
    """New rows take the place of those with the same key, in the buckets that they touch; the others are neither read nor written.

    Of new rows with one key the one with the largest ``order`` stands (without one, any of those that differ, the same each
    time). Those buckets are worked out in full before one of them is replaced, and Spark puts them in their places only when
    all are written: a run that breaks off before leaves the table as it was, and can be repeated. A null key is a key.
    Returns the buckets that were replaced.
    """
    spark = new.sparkSession
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in new.columns])))
    added = _with_bucket(new, key, buckets).withColumn("_new", F.lit(1))
    added = cut(top_row(added, [key], [*([F.col(order).desc_nulls_last()] if order else []), row]))
    touched = sorted(r[0] for r in added.select(BUCKET).distinct().collect())  # ``buckets`` at most
    if not touched:
        return []
    kept = spark.read.schema(f"{new._jdf.schema().toDDL()}, {BUCKET} int").parquet(path).where(F.col(BUCKET).isin(touched)).withColumn("_new", F.lit(0))
    both = kept.unionByName(added)
    after = cut(top_row(both, [key], [F.desc("_new")]).drop("_new"))
    after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def history(summary: DataFrame, path: str) -> None:
    """Append a row of scores with its time."""
    summary.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


ANSWERS = "qid string, answer double"


def cached_answers(spark: SparkSession, questions: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The answers kept at ``path``, none where nothing is kept yet, and the questions that have no answer among them."""
    try:
        kept = spark.read.schema(ANSWERS).parquet(path).where("answer is not null").dropDuplicates(["qid"])
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], ANSWERS)
    return kept, questions.join(kept, "qid", "left_anti")


def keep_answers(answers: DataFrame, path: str) -> None:
    """Adds answers (qid, answer) to those kept at ``path``; unknown ones are left to be asked again."""
    answers.where("answer is not null").select(F.col("qid").cast("string"), F.col("answer").cast("double")).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str, valid: bool) -> dict:
    """What a release is made of: time, commit, rows and SHA-256 of each file."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False).stdout.strip() or None
    rows = spark.read.csv(path, header=True).count()
    return {"timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "git_commit": commit, "files": [r.asDict() for r in files], "rows": rows, "validator_passed": valid}


def markdown(title: str, sections: dict[str, DataFrame], most: int = 25) -> str:
    """A report with a table for each section, of ``most`` rows at most."""
    out = [f"# {title}", ""]
    for name, rows in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
        out.append("")
    return "\n".join(out)


def freeze(spark: SparkSession, path: str, valid: bool) -> str:
    """Keeps a release: its manifest beside it, and a copy of both below ``archive`` under the time and the digest; returns the copy's folder.

    The files are copied as they are, by the file system's own client. Answers that are not valid are refused.
    """
    if not valid:
        raise ValueError("answers that are not valid are not released")
    found = manifest(spark, path, valid)
    digest = hashlib.sha256("".join(f["sha256"] for f in found["files"]).encode()).hexdigest()
    parent, name = path.rstrip("/").rpartition("/")[::2]
    at = found["timestamp"].replace(":", "").replace("-", "")[:15]
    folder = f"{parent or '.'}/archive/{name}-{at}-{digest[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, copy = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{folder}/answers"))
    source.getFileSystem(conf).mkdirs(copy.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)
    text = spark.createDataFrame([(manifest_json(found),)], "value string")
    for place in (f"{path.rstrip('/')}.manifest", f"{folder}/manifest"):
        text.write.mode("overwrite").text(place)
    return folder


def manifest_json(found: dict) -> str:
    return json.dumps(found, indent=2, sort_keys=True)
