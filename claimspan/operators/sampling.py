"""Splits and samples by hash, so that rows draw the same lot on every run and in every order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pool rows numbered in one hash bucket.
NUMBERED = 50_000


def lot(seed: int, *key: str) -> Column:
    """A number in [0, 1) from the hash of the key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40)


def split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 13) -> DataFrame:
    """Adds ``part``: train or validation, about ``share`` of the rows of every stratum in train. No shuffle."""
    return rows.withColumn("part", F.when(lot(seed, key) < share, "train").otherwise("validation"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int = 13) -> DataFrame:
    """At least one and about total / strata rows of each stratum, those with the smallest hash; ``total`` at most.

    The window keeps k rows a stratum in every task before the shuffle, so a stratum of any size is fine."""
    strata = rows.select(stratum).distinct().count()
    each = max(1, total // max(strata, 1))
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).orderBy("k", F.xxhash64(F.lit(seed), key)).limit(total).drop("k")


def numbered(pool: DataFrame, total: int, seed: int) -> DataFrame:
    """The pool (chunk_id, text) with ``position`` 0 to total - 1, the same on every run: rows are numbered in hash buckets
    and each bucket starts where the earlier ones end, so no task sorts the pool. Equal rows are rows of their own."""
    buckets = max(16, total // NUMBERED)
    tied = pool.withColumn("tie", F.xxhash64(F.lit(seed), "chunk_id", "text"))
    spread = tied.withColumn("bucket", F.pmod("tie", F.lit(buckets)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("tie", "chunk_id")
    placed = spread.withColumn("at", F.row_number().over(inside) - 1).join(offsets, "bucket")
    return placed.select("chunk_id", "text", (F.col("offset") + F.col("at")).alias("position"))


def drawn(total: int, each: int, sample: str, seed: int) -> Column:
    """min(each, total) different numbers below total in random order, every set of them equally likely (Floyd's
    algorithm), from the hash of the sample."""
    steps = F.array(*(F.lit(j) for j in range(max(total - each, 0), total))).cast("array<bigint>")
    one = lambda j: F.pmod(F.xxhash64(F.lit(seed), sample, j), j + 1)
    chosen = F.aggregate(steps, F.array().cast("array<bigint>"), lambda found, j: F.concat(found, F.array(F.when(F.array_contains(found, one(j)), j).otherwise(one(j)))))
    return F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(F.xxhash64(F.lit(seed + 1), sample, x).alias("lot"), x.alias("position")))), lambda x: x["position"])


def add_distractors(chunks: DataFrame, pool: DataFrame, each: int, sample: str = "sample_id", seed: int = 13, samples: DataFrame | None = None) -> DataFrame:
    """Chunks (sample, chunk_id, text, rank) plus ``each`` chunks of the pool per sample, ranked after its own.

    Every sample draws min(each, pool size) different rows of the whole pool by its own hash. The pool is numbered and
    joined on the number, so no sample meets the whole pool. ``samples`` (sample) also names samples without chunks,
    whose distractors are ranked from 1. The size of the pool is the only figure on the driver."""
    total = pool.count()
    sizes = chunks.groupBy(sample).agg(F.max("rank").alias("last"))
    if samples is not None:
        sizes = samples.select(sample).distinct().join(sizes, sample, "left").na.fill(0, ["last"])
    lots = sizes.select(sample, "last", F.posexplode(drawn(total, each, sample, seed)).alias("k", "position"))
    noise = lots.join(numbered(pool.select("chunk_id", "text"), total, seed), "position").select(sample, "chunk_id", "text", (F.col("last") + F.col("k") + 1).cast("int").alias("rank"), F.lit(True).alias("distractor"))
    return chunks.select(sample, "chunk_id", "text", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("distractor")).unionByName(noise)
