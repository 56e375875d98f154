"""Queries of problem 2: sentence units of retrieved chunks and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .sentence_units import fit_on, sentence_units


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = spread(table(spark, folder, "retrieval_json").select("row_id", "retrieved_chunks")).select("row_id", F.posexplode("retrieved_chunks.text").alias("at", "text"))
    questions = spread(table(spark, folder, "averitec").select("record_id", "questions")).select("record_id", F.posexplode("questions.answers").alias("q", "answers"))
    answers = questions.select("record_id", "q", F.posexplode("answers.answer").alias("at", "text"))
    return chunks.select(F.lit("retrieval_json").alias("table_name"), F.concat_ws("/", "row_id", "at").alias("item_key"), "text").unionByName(
        answers.select(F.lit("averitec").alias("table_name"), F.concat_ws("/", "record_id", "q", "at").alias("item_key"), "text")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return sentence_units(texts, fit_on(texts))


def p2_unit_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Units per table by tens of characters, up to 500 and above."""
    tens = F.least(F.floor((F.col("char_end") - F.col("char_start")) / 10) * 10, F.lit(500)).cast("int")
    return p2_found(spark, folder).groupBy("table_name", tens.alias("chars_from")).agg(F.count("*").alias("units"))


QUERIES = {f.__name__: f for f in (p2_found, p2_unit_lengths)}

#: None: a trained model. tests/llm/test_sentences.py has marked texts in ten languages.
ORACLES: dict[str, str] = {}
