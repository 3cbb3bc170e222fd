"""CSV of any size: records whose quoted cells hold line ends, from pieces of text that are cut anywhere.

A line end closes a record only outside quotes, and whether a piece begins inside quotes depends on all text before
it. That is a sum: the parity of the quotes so far. Each piece is counted once for both cases, the counts are summed up
in two levels (within chunks of pieces, then over the chunks of a file), and then every piece is split by itself; only
what is left over at its ends meets again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK, _KEPT, _BREAK = "\u0001", "\u0001\u0002", "\u0001\u0003"


def _parts(text: Column, separator: str, quoted: Column | None = None) -> Column:
    """The text cut at each separator outside quotes; quoted: whether the text begins inside quotes."""
    safe = F.replace(text, F.lit(_MARK), F.lit(_KEPT))
    start = F.lit(0) if quoted is None else quoted.cast("int")
    outside = F.transform(F.split(safe, '"', -1), lambda s, i: F.when((i + start) % 2 == 0, F.replace(s, F.lit(separator), F.lit(_BREAK))).otherwise(s))
    return F.transform(F.split(F.array_join(outside, '"'), _BREAK, -1), lambda s: F.replace(s, F.lit(_KEPT), F.lit(_MARK)))


def records(pieces: DataFrame) -> DataFrame:
    """file, row_num (from 0), record of every record of the files that ``pieces`` (file, chunk, at, text) make up.

    The text of a file is that of its pieces in the order of chunk and at; where one piece ends and the next begins
    is of no account. A record is what stands between line ends outside quotes, without its own line end; the
    empty one after a file's last line end is none, other empty ones count. A null text is empty. A chunk is what
    one task can put in order, such as the lines of a block of a file.
    """
    pieces = pieces.select("file", "chunk", "at", F.coalesce("text", F.lit("")).alias("text"))
    breaks = lambda quoted: F.size(_parts(F.col("text"), "\n", F.lit(quoted))) - 1
    counted = pieces.select("file", "chunk", "at", (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).alias("q"), breaks(False).alias("outside"), breaks(True).alias("inside"))
    order = Window.partitionBy("file", "chunk").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    odd = F.col("q_before") % 2 == 1
    counted = counted.withColumn("q_before", so_far("q", before))
    # breaks of a piece if its chunk begins outside quotes, and if it begins inside
    counted = counted.withColumns({"plain": F.when(odd, F.col("inside")).otherwise(F.col("outside")), "turned": F.when(odd, F.col("outside")).otherwise(F.col("inside"))})
    counted = counted.withColumns({"plain_before": so_far("plain", before), "turned_before": so_far("turned", before)})
    chunks = counted.groupBy("file", "chunk").agg(F.sum("q").alias("q"), F.sum("plain").alias("plain"), F.sum("turned").alias("turned"))
    of_file = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("begins", so_far("q", of_file) % 2)
    chunks = chunks.withColumn("base", so_far(F.when(F.col("begins") == 1, F.col("turned")).otherwise(F.col("plain")), of_file)).select("file", "chunk", "begins", "base")
    state = counted.join(chunks, ["file", "chunk"])
    begun = F.when(F.col("begins") == 1, F.col("turned_before")).otherwise(F.col("plain_before"))
    state = state.select("file", "chunk", "at", ((F.col("begins") + F.col("q_before")) % 2 == 1).alias("quoted"), (F.col("base") + begun).alias("base"))
    cut = pieces.join(state, ["file", "chunk", "at"]).select("file", "chunk", "at", "base", _parts(F.col("text"), "\n", F.col("quoted")).alias("parts"))
    cut = cut.select("file", "chunk", "at", "base", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part")).withColumn("row_num", F.col("base") + F.col("i"))
    whole = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    within = cut.where(whole).select("file", "row_num", F.col("part").alias("record"), F.lit(True).alias("closed"))
    # the first and the last part of a piece go on in its neighbours; the last record is closed if a line end follows
    ends = cut.where(~whole).groupBy("file", "row_num").agg(F.array_sort(F.collect_list(F.struct("chunk", "at", "i", "part"))).alias("p"), F.max(F.col("i") < F.col("n") - 1).alias("closed"))
    ends = ends.select("file", "row_num", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("record"), "closed")
    every = within.unionByName(ends).where("closed or record <> ''")
    return every.select("file", "row_num", F.regexp_replace("record", "\r$", "").alias("record"))


def cells(record: Column) -> Column:
    """The cells of a record, however many: commas inside quotes do not part them, and two quotes inside quotes are one."""
    shaped = F.transform(_parts(record, ","), lambda c: F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return shaped


def pieces_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files as pieces: each block of a file is a chunk, read by a task of its own."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"), F.col("value"))
    return lines.select("file", "chunk", F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("\n")).alias("text"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """qid, raw_answer, row_num of files of answers. The heading may be missing; the id's column is question_id or qid, the answer's ``answer``, else the second.

    Records that have too few cells or no id are left out, as are blank ones. row_num counts the records of a file.
    """
    rows = records(pieces_of_files(spark, path)).where("trim(record) <> ''").withColumn("x", cells(F.col("record")))
    names = F.transform("x", lambda c: F.lower(F.trim(c)))
    place = lambda c, name: F.nullif(F.array_position(c, name), F.lit(0))
    first = rows.where("row_num = 0").select("file", names.alias("names"))
    heads = first.select("file", F.coalesce(place(F.col("names"), "question_id"), place(F.col("names"), "qid")).alias("id_at"), place(F.col("names"), "answer").alias("named_at"), F.size("names").alias("wide"))
    rows = rows.join(heads, "file", "left")  # a row for each file
    id_at = F.coalesce("id_at", F.lit(1)).cast("int")
    answer_at = F.when(F.col("id_at").isNotNull(), F.coalesce("named_at", F.when(F.col("wide") > 1, 2).otherwise(1))).otherwise(2).cast("int")
    rows = rows.where(F.col("id_at").isNull() | (F.col("row_num") > 0)).where(F.size("x") >= F.greatest(id_at, answer_at))
    rows = rows.select(F.trim(F.element_at("x", id_at)).alias("qid"), F.trim(F.element_at("x", answer_at)).alias("raw_answer"), "row_num")
    return rows.where("qid <> ''")
