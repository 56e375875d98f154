"""Queries of problem 4: evaluation claims that are also in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread, table
from .split_overlap import cross_split_pairs, overlap_counts


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_pairs(spread(table(spark, folder, "averitec").select("record_id", "split", "claim"))).select("record_id_a", "record_id_b")


def p4_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, records concerned and pairs with equal words per split and reporting source."""
    return overlap_counts(spread(table(spark, folder, "averitec").select("record_id", "split", "claim", "reporting_source")), "reporting_source")


QUERIES = {f.__name__: f for f in (p4_found, p4_overlap_report)}

#: None: names, misspellings and digit grouping are beyond SQL. tests/llm/test_overlap.py compares with all pairs.
ORACLES: dict[str, str] = {}
