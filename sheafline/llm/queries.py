"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, fim, runs, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives

    return derivatives(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), stored=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count

    mixed = mix(table(spark, sf_dir, "documents"), F.array("source"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz import fingerprints_with_next

    return fingerprints_with_next(table(spark, sf_dir, "documents"), stored=True)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls, seed_urls

    return filter_urls(table(spark, sf_dir, "pages"), seed_urls(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests, periodic_runs, with_repeats

    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back, with_trial

    return read_back(format_conversations(with_trial(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_source_mixing": op5_source_mixing,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_lz_fingerprints": op7_lz_fingerprints,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}
SQL: dict[str, str] = {
    "op1_warc_derivatives": warc.SQL,
    "op3_substring_dedup": substring.SQL,
    "op8_embedding_dedup": embeddings.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_periodic_runs": runs.SQL,
    "op13_chat_format": chat.SQL,
}
