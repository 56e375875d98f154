"""Incremental runs of the claim pipeline: an extension, as batches of retrieval records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import claims as C


def labelled_pairs(retrieval: DataFrame, sample: str = "row_id") -> DataFrame:
    """Claims, candidate pairs and labels of retrieval records, all in one plan."""
    claims = C.sentence_claims(C.chunk_inputs(retrieval, sample), sample)
    ordered = claims.withColumn("ord", F.struct("chunk_ord", "sent_no"))
    pairs = C.label_pairs(C.candidate_pairs(ordered, sample))
    return pairs.select(sample, "claim_id_a", "claim_id_b", "lexical", "label")


def run_stream(source: DataFrame, out: str, checkpoint: str, sample: str = "row_id", seen: str | None = "exported_at", late: str = "7 days") -> StreamingQuery:
    """Labels each micro-batch and appends it to the Parquet folder ``out``.

    With ``seen`` (an event time) a record that is delivered again within ``late`` is processed once. A batch that is
    retried overwrites its own folder, so a failure leaves no doubles."""
    rows = source
    if seen:
        rows = rows.withWatermark(seen, late).dropDuplicatesWithinWatermark([sample])

    def label(batch: DataFrame, number: int) -> None:
        labelled_pairs(batch, sample).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(source: DataFrame, time: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key and window of event time; rows later than ``late`` are not counted. Batch or stream."""
    return source.withWatermark(time, late).groupBy(F.window(time, window, slide) if slide else F.window(time, window), key).agg(F.count("*").alias("rows"))
