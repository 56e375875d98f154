import statistics

import pytest
from pyspark.sql import functions as F

from claimspan.operators import diagnostics as D


@pytest.mark.parametrize(
    "query, bucket",
    [
        ('He said "no"', "quoted_or_attribution_heavy"), ("The bank reported a loss", "quoted_or_attribution_heavy"), ("It opened in 1988", "temporal_query"), ("It opened in March", "temporal_query"),
        ("Ann Lee is an actor", "ambiguous_name_query"), ("Tam is a harbour town in the far north", "entity_seeking"), ("Cats hunt", "very_short_factoid"), (None, "very_short_factoid"),
        ("The council will close the old harbour", "yes_no_claim_like"),
    ],
)
def test_buckets(spark, query, bucket):
    assert spark.createDataFrame([(query,)], "q string").select(D.query_bucket(F.col("q")).alias("b")).first().b == bucket


def test_failure_label_order(spark):
    row = lambda *x: spark.createDataFrame([x], "p int, s boolean, c boolean, n boolean, b string, t int").select(D.failure_label(*map(F.col, "pscnbt")).alias("f")).first().f
    assert row(0, True, True, True, "entity_seeking", 3) == "NO_CROSS_SOURCE_SIGNAL"
    assert row(1, True, True, True, "entity_seeking", 3) == "Q_SHORT"
    assert row(1, True, True, True, "temporal_query", 9) == "Q_COLLAPSED_IN_P1"
    assert row(1, False, False, True, "temporal_query", 9) == "EVIDENCE_STILL_NOISY"
    assert row(1, False, False, False, "temporal_query", 7) == "Q_UNDERSPECIFIED"
    assert row(1, False, False, False, "temporal_query", 9) == "EVIDENCE_OK_BUT_NOT_COMPARABLE"


def test_rules_and_clusters(spark):
    typed = spark.createDataFrame([(1, 0, "a", "b", "conflict", "time"), (1, 1, "b", "c", "agreement", "time"), (1, 2, "a", None, "agreement", "calm")], "payload_id int, pair_no int, claim_a_id string, claim_b_id string, signal string, rule string")
    fired = {r.rule: (r.fired, r.tag) for r in D.fired_rules(typed).collect()}
    assert fired["time"] == (2, "DOMINANT") and fired["number"] == (0, "DEAD") and fired["calm"] == (1, None)
    assert {(r.claim_id, r.cluster) for r in D.evidence_clusters(typed).collect()} == {("a", "oppose"), ("b", "oppose"), ("c", "support")}
    assert D.fired_rules(typed.limit(0)).where("tag = 'DEAD'").count() == len(D.RULES)


def test_exclusive_decile(spark):
    values = {"x": [5, 1, 9, 9, 3, 7, 2, 8, 4, 6, 12], "y": [3, 3]}
    rows = [(g, v, "clash") for g, vs in values.items() for v in vs] + [("x", None, "clash")]
    got = {r.g: r for r in D.exclusive_percentile(spark.createDataFrame(rows, "g string, v int, n string"), "g", "v").collect()}
    for g, vs in values.items():
        assert abs(got[g].decile - statistics.quantiles(vs, n=10)[-1]) < 1e-3 and abs(got[g]["mean"] - statistics.mean(vs)) < 1e-3
    one = D.exclusive_percentile(spark.createDataFrame([("z", 4)], "g string, v int"), "g", "v").first()
    assert one.decile == 4


def test_relevance_gate(spark):
    df = spark.createDataFrame([("harbour toll", "The TOLL rose"), ("harbour", "cats"), ("", "x"), (None, "x")], "q string, t string").select(D.relevant(F.col("q"), F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == [True, False, True, True]
