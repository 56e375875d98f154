"""Queries of problem 5: splitting oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .cohesion_split import split_oversized

FIELDS = {"document_records": "document_records.full_text", "retrieval_json": "retrieval_json.retrieved_chunks.text"}


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    records = spread(table(spark, folder, "document_records").select("doc_id", "full_text")).select(F.lit("document_records").alias("table_name"), F.col("doc_id").alias("item_key"), F.col("full_text").alias("text"))
    chunks = (
        spread(table(spark, folder, "retrieval_json").select("row_id", "retrieved_chunks"))
        .select("row_id", F.posexplode("retrieved_chunks.text").alias("at", "text"))
        .select(F.lit("retrieval_json").alias("table_name"), F.concat_ws("/", "row_id", "at").alias("item_key"), "text")
    )
    items = records.unionByName(chunks)
    names = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    limits = table(spark, folder, "size_limits").where(F.col("unit") == "chars")
    return split_oversized(items.withColumn("field_name", names[F.col("table_name")]), limits)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where(F.col("piece_no") == 0).select("table_name", "item_key")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p5_boundary_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces, their mean size and largest size per table and way of cutting."""
    size = F.col("char_end") - F.col("char_start")
    return _pieces(spark, folder).groupBy("table_name", "boundary").agg(F.count("*").alias("pieces"), F.sum(size).alias("chars"), F.max(size).alias("largest"))


QUERIES = {f.__name__: f for f in (p5_found, p5_pieces, p5_boundary_report)}

ORACLES = {
    "p5_found": """
        select 'document_records' as table_name, doc_id as item_key from document_records, size_limits
        where field_name = 'document_records.full_text' and unit = 'chars' and length(full_text) > max_size
        union all
        select 'retrieval_json', row_id || '/' || i from (
          select row_id, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json), size_limits
        where field_name = 'retrieval_json.retrieved_chunks.text' and unit = 'chars' and length(c.text) > max_size""",
}
