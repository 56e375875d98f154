"""Queries of problem 6: nested JSON bodies as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested_json as nj
from ..runtime import table


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nj.flatten_records(table(spark, folder, "raw_records"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).where(F.col("node_kind").isin("answer", "claim", "nli_result")).select(
        "record_id", "record_no", F.col("node_kind").alias("child_kind"), "parent_no", "child_no"
    )


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return nj.records_table(_nodes(spark, folder))


def p6_questions(spark: SparkSession, folder: str) -> DataFrame:
    return nj.questions_table(_nodes(spark, folder))


def p6_answers(spark: SparkSession, folder: str) -> DataFrame:
    return nj.answers_table(_nodes(spark, folder))


def p6_claims(spark: SparkSession, folder: str) -> DataFrame:
    return nj.claims_table(_nodes(spark, folder))


def p6_nli_results(spark: SparkSession, folder: str) -> DataFrame:
    return nj.nli_results_table(_nodes(spark, folder))


QUERIES = {f.__name__: f for f in (p6_found, p6_records, p6_questions, p6_answers, p6_claims, p6_nli_results)}

#: None in SQL: bodies that hold lists as strings, single objects or cut-off text are compared with a brute-force
#: reader (the json module) in tests/test_nested_json.py.
ORACLES: dict[str, str] = {}
