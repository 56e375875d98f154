"""Queries of problem 3: duplicates hidden by formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .canonical_copies import copies_of, distinct_records, numbered_records, record_pairs


def _records(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "benchmark_rows").select(F.explode("claims").alias("c")).select("c.claim_id", "c.text")
    return numbered_records(
        {
            "documents": record_pairs(table(spark, folder, "documents"), "doc_id", "text"),
            "document_records": record_pairs(table(spark, folder, "document_records"), "doc_id", "full_text"),
            "benchmark_rows": record_pairs(claims, "claim_id", "text"),
            "claim_lines": record_pairs(table(spark, folder, "claim_lines"), "line_id", "body", as_json=True),
        }
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies_of(_records(spark, folder))


def p3_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct record once, with its number of copies."""
    return distinct_records(_records(spark, folder))


QUERIES = {f.__name__: f for f in (p3_found, p3_copy_counts)}

#: None: SQL has no canonical form of JSON with fields in any order. tests/llm/test_copies.py compares with brute force.
ORACLES: dict[str, str] = {}
