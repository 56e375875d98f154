"""Queries of problems 7 and 8: packing and mixing by token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, spread, table
from .container_packing import pack, program_report
from .source_mixing import mix, share_report
from .token_sizes import token_sizes


def _capacity(spark: SparkSession, folder: str) -> int:
    limits = table(spark, folder, "size_limits").where("field_name = 'documents.text' and unit = 'tokens'")
    return int(limits.agg(F.min("max_size").alias("n")).first()["n"])


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_sizes(spread(table(spark, folder, "documents").select("doc_id", "text")))
    return pack(sizes, _capacity(spark, folder))


def p7_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by tenth of their capacity that is filled."""
    capacity = _capacity(spark, folder)
    filled = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return filled.groupBy(F.floor(F.col("tokens") * 10 / capacity).cast("int").alias("tenths_filled")).agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(capacity - F.col("tokens")).alias("unused")
    )


def p7_program(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used against the value of the program and the lower bounds."""
    sizes = token_sizes(spread(table(spark, folder, "documents").select("doc_id", "text")))
    return program_report(sizes, _capacity(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_sizes(spread(table(spark, folder, "documents").select("doc_id", "source", "text")))
    return mix(sizes, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p8_share_report(spark: SparkSession, folder: str) -> DataFrame:
    return share_report(cut(_mixed(spark, folder)), table(spark, folder, "mix_targets"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_fill_report, p7_program, p8_mix, p8_share_report)}

#: None: token counts are not expressible in SQL. tests/llm/test_tokens.py checks capacity, completeness and shares.
ORACLES: dict[str, str] = {}
