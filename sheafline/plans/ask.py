"""Questions in words to answers: the client, engineer and package are found in the text, then the primary solver answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import package_code
from ..operators.lineage import cut, shuffled
from ..operators.resolve import found_entities, normalized, resolve
from . import primary


def _clients(certs: DataFrame) -> DataFrame:
    return certs.where("client_name is not null and client_name <> ''").select(F.col("client_name").alias("entity")).distinct()


def _engineers(certs: DataFrame, personnel: DataFrame) -> DataFrame:
    leads, holders = (rows.select(F.col(name).alias("entity")) for rows, name in ((certs, "project_lead"), (personnel, "engineer_name")))
    return leads.unionByName(holders).where("entity is not null and entity <> ''").distinct()


def clients_of(questions: DataFrame, certs: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """qid, entity, layer: the client that a question is about; packages and first names of leads help."""
    return resolve(questions.select("qid", F.col("question").alias("text")), _clients(certs), certs, choices)


def engineers_of(questions: DataFrame, certs: DataFrame, personnel: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """qid, entity, layer: the engineer that a question is about, of all who lead a project or hold a certificate."""
    return resolve(questions.select("qid", F.col("question").alias("text")), _engineers(certs, personnel), None, choices)


def answer(questions: DataFrame, certs: DataFrame, letters: DataFrame, receivables: DataFrame, personnel: DataFrame, client_choices: DataFrame | None = None, engineer_choices: DataFrame | None = None) -> DataFrame:
    """qid, client, engineer, package, shape and answer of every question (qid, question, answer_type).

    The other tables are as for ``primary.solve``. Where a name is not found the shapes that need it do not apply, and
    the default of the answer's type stands. A null question names nothing. Each qid is one question.
    """
    texts = cut(normalized(questions.select("qid", F.col("question").alias("text"), "answer_type")))
    client = found_entities(texts, _clients(certs), certs, client_choices).select("qid", F.col("entity").alias("client"))
    engineer = found_entities(texts, _engineers(certs, personnel), None, engineer_choices).select("qid", F.col("entity").alias("engineer"))
    named = texts.select("qid", F.col("text").alias("question"), "answer_type").join(shuffled(client), "qid", "left").join(shuffled(engineer), "qid", "left").withColumn("package", package_code(F.col("question")))
    return primary.solved(named, certs, letters, receivables, personnel).select("qid", "client", "engineer", "package", "shape", "answer")
