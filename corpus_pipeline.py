"""A corpus pipeline of five stages, each a Spark job over all that the one before kept.

language ID, SimHash near-dedup, substring dedup, mixing of sources, packing.
Each stage takes (spark, docs, sf_dir); all but the last return the columns of
docs. docs has at least doc_id, text, lang, source and n_chars; a stage carries
each row in one struct, so further columns may have any name and stay as they
are. A null text, an empty table and repeated rows are handled as the stages'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.llm import langid, mixing, packing, simhash, substring
from sheafline.llm.common import known_id, saved, shuffled, whole_row

#: A document is rejected if its language is predicted with less than this score.
LEAST_LANGUAGE_SCORE = 0.5


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``, those named in ``new`` made anew, with the types that they had."""
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, with a null text, or of too low a score go. lang is left as it is.

    Repeated rows are judged alike, each by itself; a null doc_id is a document
    like another; an empty table gives no rows.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = docs.select(whole_row(docs).alias("row"), langid.language_of(spark, F.col("text"), model).alias("language"))
    return _unpacked(judged.where((F.col("language.lang_pred") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest doc_id (null before all others), then the smallest hash of its text.

    Rows that share both go by their other columns, written as JSON; only rows
    that are alike in every column are left to chance. Null and empty texts are
    near-duplicates of one another; an empty table gives no rows.
    """
    kept = simhash.first_of_groups(docs).select(F.col("doc").alias("kept_id"), F.col("th").alias("kept_text"))
    rows = docs.select(known_id("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.to_json(whole_row(docs, ("doc_id", "text")), {"ignoreNullFields": "false"}).alias("others"), whole_row(docs).alias("row"))
    stay = rows.join(shuffled(kept), (F.col("id") == F.col("kept_id")) & (F.col("th") == F.col("kept_text")), "left_semi")
    alike = Window.partitionBy("id", "th").orderBy("others")
    return _unpacked(stay.withColumn("nth", F.row_number().over(alike)).where("nth = 1"), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of long repeated spans; a document of which no word is left goes.

    A text without such a span stays as it is, null and empty ones too; n_chars
    follows the text where that changes. Rows that repeat a doc_id or a whole row
    are told apart as in ``remove_repeats``; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", whole_row(docs, ("text",)).alias("row"))
    cut = substring.remove_repeats(rows, carry=("row",)).where("n_words = 0 or n_removed < n_words")
    return _unpacked(cut, docs, text=F.col("kept"), n_chars=F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row")["n_chars"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document taken twice stands twice, one taken in part has its first words.

    A null source is one of its own. Documents without a word (null and empty
    texts) are not taken; repeated rows are taken one by one; an empty table
    gives no rows. text and n_chars change only where a part is taken.
    """
    rows = docs.select("doc_id", "source", "text", whole_row(docs).alias("row"))
    mixed = mixing.mix(rows, F.array(F.col("source").cast("string")), mixing.word_count(F.col("text")), carry=("row",)).where("taken > 0")
    passes = F.transform(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int")), lambda i: F.least("size", F.col("taken") - i * F.col("size")))
    mixed = mixed.select("row", "size", F.explode(passes).alias("n"))
    text, whole = F.col("row")["text"], F.col("n") >= F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("n").cast("int")), " ")
    mixed = mixed.select("row", whole.alias("whole"), F.when(whole, text).otherwise(part).alias("part"))
    return _unpacked(mixed, docs, text=F.col("part"), n_chars=F.when(F.col("whole"), F.col("row")["n_chars"]).otherwise(F.length("part")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences: the columns of ``pack_documents``.

    A null or empty text is its end token alone, a null doc_id stays null,
    repeated rows are packed each by itself, an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot tokenize, train or solve the flow; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
