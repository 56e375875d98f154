"""Distractors: every sample draws from the whole pool by itself."""

import pytest
from pyspark.sql import functions as F

from claimspan.operators import sampling as P


def drawn(spark, samples, pool, each, parts=4):
    chunks = spark.range(samples).select(F.col("id").cast("string").alias("sample_id"), F.lit("own").alias("chunk_id"), F.lit("t").alias("text"), F.lit(3).alias("rank")).repartition(parts)
    rows = spark.range(pool).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(parts)
    out = P.add_distractors(chunks, rows, each).collect()
    assert sum(not r.distractor for r in out) == samples
    noise = {}
    for r in sorted((r for r in out if r.distractor), key=lambda r: r["rank"]):
        assert r.text == f"text {r.chunk_id}"
        noise.setdefault(r.sample_id, []).append((r["rank"], int(r.chunk_id)))
    return noise


@pytest.mark.parametrize("pool, each", [(1, 2), (2, 2), (5, 3), (40, 2), (40, 0), (0, 2)])
def test_distractors_are_full_and_different(spark, pool, each):
    noise, k = drawn(spark, 50, pool, each), min(pool, each)
    assert len(noise) == (50 if k else 0)
    for rows in noise.values():
        assert [rank for rank, _ in rows] == list(range(4, 4 + k)) and len({c for _, c in rows}) == k


def test_distractors_reach_the_whole_pool(spark):
    noise = drawn(spark, 4000, 400, 2)
    used = [c for rows in noise.values() for _, c in rows]
    assert set(used) == set(range(400)) and max(map(used.count, range(400))) < 60
    assert len({tuple(c for _, c in rows) for rows in noise.values()}) > 3500
    assert noise == drawn(spark, 4000, 400, 2, parts=7)


def test_pool_is_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED", 10)
    pool = spark.range(500).select((F.col("id") % 100).cast("string").alias("chunk_id"), F.lit("same").alias("text"))
    assert sorted(r.position for r in P.numbered(pool, 500, 13).collect()) == list(range(500))


def test_samples_without_chunks_draw_too(spark):
    chunks = spark.createDataFrame([("a", "own", "t", 2)], "sample_id string, chunk_id string, text string, rank int")
    pool = spark.range(9).select(F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("text"))
    names = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    ranks = sorted((r.sample_id, r["rank"], r.distractor) for r in P.add_distractors(chunks, pool, 2, samples=names).collect())
    assert ranks == [("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("b", 2, True)]
