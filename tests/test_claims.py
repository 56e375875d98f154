"""Goldens of pairs, inference, conflict types and scores."""

import random

import pytest
from pyspark.sql import functions as F

from claimspan.operators import claims as C
from claimspan.operators import conflict as K
from claimspan.operators import metrics as M
from claimspan.operators.retrieval import hash_vectors
from claimspan.sources import readers as R

CLAIM = "sample_id string, ord int, claim_id string, text string, role string, entities array<string>"


def test_blocking_modes(spark):
    rows = [
        ("s", 0, "a", "Alice approved the harbour plan", "query", ["Alice"]), ("s", 1, "b", "Alice did not approve the harbour plan", "retrieved_evidence", ["Alice"]),
        ("s", 2, "c", "Bob sold the harbour plan", "retrieved_evidence", ["Bob"]), ("s", 3, "d", "harbour plan", "body", []), ("s", 4, "e", None, None, None), ("t", 0, "a", "Alice approved the harbour plan", "query", ["Alice"]),
    ]
    df = spark.createDataFrame(rows, CLAIM).withColumn("tokens_", F.lit(1))
    pairs = lambda **k: {(r.claim_id_a, r.claim_id_b) for r in C.candidate_pairs(df, **k).collect()}
    assert pairs() == {("a", "b"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert pairs(allow_empty_entities=False) == {("a", "b")}
    assert pairs(mode="union", allow_empty_entities=False) <= pairs(mode="union")
    assert pairs(query_lexical=0.99, least_lexical=0.1) == {("a", "d"), ("b", "d"), ("c", "d")}
    assert C.candidate_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.candidate_pairs(df, mode="other")


def test_index_finds_the_same_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(rng.choice("st"), i, str(i), " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(0, 9))), rng.choice(["query", "retrieved_evidence"]), rng.sample(["A", "B", "C"], rng.randint(0, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, CLAIM)
    for least, asked in ((0.1, None), (0.4, None), (0.5, 0.2)):
        found = [sorted((r.sample_id, r.ord_a, r.ord_b, r.lexical) for r in C.candidate_pairs(df, least_lexical=least, query_lexical=asked, indexed=x).collect()) for x in (False, True)]
        assert found[0] == found[1] and found[0]
    assert C.candidate_pairs(df.limit(0), indexed=True).count() == 0
    with pytest.raises(ValueError):
        C.candidate_pairs(df, least_lexical=0.0, indexed=True)


def test_index_broadcasts_nothing(spark, tmp_path):
    """Lists inside a small file hold more words than the planner thinks, so no side may be broadcast by its estimate."""
    rows = [(str(i % 5), i, str(i), f"harbour plan {i % 7} of ship {i % 3}", "body", ["A"]) for i in range(40)]
    spark.createDataFrame(rows, CLAIM).write.parquet(str(tmp_path / "claims"))
    pairs = C.candidate_pairs(spark.read.parquet(str(tmp_path / "claims")), indexed=True)
    plan = lambda: pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan()
    assert pairs.collect() and "isFinalPlan=true" in plan() and "Broadcast" not in plan()


def test_blocking_embedding_stage(spark):
    texts = ["Alice approved the harbour plan", "Alice did not approve the harbour plan", "Bob sold the harbour plan", "harbour plan", None, "unrelated words"]
    entities = [["Alice"], ["Alice"], ["Bob"], [], None, ["Alice"]]
    df = spark.createDataFrame([("s", i, "abcdef"[i], t, "body", e) for i, (t, e) in enumerate(zip(texts, entities, strict=True))], CLAIM)
    df = df.unionByName(df)  # a repeated sample: every copy is a claim of its own
    rows = lambda **k: {(r.claim_id_a, r.claim_id_b): r for r in C.candidate_pairs(df, **k).collect()}
    pairs = lambda **k: set(rows(**k))
    near = {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    # Without a threshold the embedding stage passes, so union is the lexical stage alone.
    assert pairs(mode="union") == pairs(mode="union", allow_empty_entities=False) == near
    assert pairs(mode="union", least_embedding=2.0) == pairs() and pairs(least_embedding=2.0) == set()
    vector = {r.claim_id: r.vector for r in hash_vectors(df, key="claim_id").collect()}
    cosine = lambda pair: round(sum(x * y for x, y in zip(*(vector[i] for i in pair), strict=True)), 4)
    level = sorted(map(cosine, near))[3] - 1e-3
    close = {p for p in near if cosine(p) >= level}
    assert close < near
    for empty in (True, False):
        named = pairs(allow_empty_entities=empty)
        assert pairs(least_embedding=level, allow_empty_entities=empty) == named & close
        assert pairs(mode="union", least_embedding=level, allow_empty_entities=empty) == named | close
    assert {p: round(r.embedding, 4) for p, r in rows(mode="union", least_embedding=-1.0).items()} == {p: cosine(p) for p in near}
    assert C.candidate_pairs(df, mode="union").where("claim_id_a = 'a' and claim_id_b = 'b'").count() == 4


@pytest.mark.parametrize(
    "a, b, lexical, label",
    [
        ("Alice did not approve the plan", "Alice approved the plan", 0.35, "contradiction"), ("Alice did not approve the plan", "Alice denied the plan", 0.30, "entailment"),
        ("The photo is fake", "The photo is old", 0.25, "contradiction"), ("A b c", "A b c d", 0.5, "entailment"), ("A", "B", 0.0, "neutral"), (None, "x", 0.9, "entailment"),
    ],
)
def test_heuristic_inference(spark, a, b, lexical, label):
    for x, y in ((a, b), (b, a)):
        df = spark.createDataFrame([(x, y, lexical)], "text_a string, text_b string, lexical double")
        assert C.label_pairs(df).first().label == label


SCORES = "struct<entailment: double, contradiction: double, neutral: double>"


def test_ensemble_temperature_thresholds(spark):
    df = spark.createDataFrame([((0.6, 0.2, 0.2), (0.0, 0.0, 0.0), "entailment"), ((-1.0, 0.5, 0.5), (1.0, 1.0, 2.0), "neutral")], f"x {SCORES}, y {SCORES}, gold string")
    for r in C.ensemble(df, ["x", "y"], [0.5, 0.5], "z").collect():
        assert abs(sum(r.z) - 1) < 1e-9
    same = C.with_temperature(df, F.lit(1.0), "x", "z").first().z
    assert tuple(same) == (0.6, 0.2, 0.2)
    label = df.select(C.with_thresholds(F.col("x"), 0.7, 0.7).alias("l")).collect()
    assert [r.l for r in label] == ["neutral", "neutral"]
    assert C.fit_temperature(df.select(F.col("x").alias("scores"), "gold")).count() == 1
    assert C.threshold_grid(df.select(F.col("x").alias("scores"), "gold")).count() == 81
    assert C.ensemble(df.limit(0), ["x"], [1.0]).count() == 0


FEATURES = "text string, subject string, time string, role string, source_url string, source_medium string, reporting_source string, claim_date string, question string, authority double"


def typed(spark, a, b, nli="contradiction"):
    blank = dict.fromkeys(c.split()[0] for c in FEATURES.split(", "))
    rows = [tuple((blank | x).values()) for x in (a, b)]
    fa, fb = (r.features for r in K.claim_features(spark.createDataFrame(rows, FEATURES)).collect())
    known = K.claim_features(spark.createDataFrame(rows, FEATURES)).schema["features"].dataType
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("features_a", known), StructField("features_b", known), StructField("nli_label", StringType())])
    pair = spark.createDataFrame([(fa, fb, nli)], schema).withColumn("f", K.fuse(F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("nli_label"))).withColumn("signal", F.col("f.signal"))
    r = K.type_conflicts(pair).first()
    return r.conflict_type, r.policy


@pytest.mark.parametrize(
    "a, b, nli, want",
    [
        ({"text": "x", "time": "2014"}, {"text": "x", "time": "2013"}, "contradiction", ("temporal_conflict", "prefer_latest")),
        ({"text": "x", "claim_date": "2023-03-01"}, {"text": "September 2023"}, "contradiction", ("temporal_conflict", "prefer_latest")),
        ({"text": "It cost 100,000 crowns"}, {"text": "It cost 150,000 crowns"}, "contradiction", ("ambiguity", "disambiguate_first")),
        ({"text": "Michael Jordan won"}, {"text": "Michael I. Jordan won"}, "contradiction", ("ambiguity", "disambiguate_first")),
        ({"text": "x", "source_medium": "wire service"}, {"text": "x", "source_medium": "social-media"}, "contradiction", ("misinformation", "down_weight_low_quality")),
        ({"text": "x", "source_medium": "op-ed"}, {"text": "x", "source_medium": "wire_service"}, "contradiction", ("opinion_conflict", "show_all_sides")),
        ({"text": "官员表示已经完成"}, {"text": "y"}, "contradiction", ("opinion_conflict", "show_all_sides")),
        ({"text": "The council approved the harbour bridge project"}, {"text": "The council never approved the harbour bridge project"}, "neutral", ("ambiguity", "disambiguate_first")),
        ({"text": "The council approved the harbour bridge"}, {"text": "The council never approved the harbour bridge"}, "entailment", ("none", "pass_through")),
        ({"text": "x"}, {"text": "y"}, "contradiction", ("hard_contradiction", "abstain")),
    ],
)
def test_conflict_types(spark, a, b, nli, want):
    assert typed(spark, a, b, nli) == want


def test_fusion(spark):
    rows = [("support", 0.8, "entailment"), ("filtered", 0.4, "neutral"), ("support", 0.0, "contradiction"), (None, None, "neutral"), ("oppose", 0.0, None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, c double, n string").select(K.fuse(F.col("s"), F.col("c"), F.col("n")).alias("f"))
    assert [(r.f.signal, round(r.f.confidence, 3)) for r in df.collect()] == [("agreement", 0.9), ("unrelated", 0.4), ("inconclusive", 0.15), ("neutral", 0.6), ("conflict", 0.5), ("inconclusive", 0.0)]


def test_roles(spark):
    rows = [("query", "body", "a_as_claim"), ("chunk", "claim", "b_as_claim"), (None, "chunk", "a_as_claim"), ("query", "claim", "bidirectional"), (None, None, "bidirectional")]
    for a, b, want in rows:
        assert spark.createDataFrame([(a, b)], "a string, b string").select(K.role_direction(F.col("a"), F.col("b")).alias("d")).first().d == want


def test_summary_abstains_on_contradiction(spark):
    rows = [(1, 0, "hard_contradiction", 0.6, "abstain"), (1, 1, "hard_contradiction", 0.6, "pass_through"), (1, 2, "none", 0.8, "pass_through"), (2, 0, "none", 0.8, "pass_through"), (2, 1, "noise", 0.8, "skip")]
    df = spark.createDataFrame(rows, "payload_id int, pair_no int, conflict_type string, confidence double, policy string")
    got = {r.payload_id: r for r in K.conflict_summary(df).collect()}
    assert got[1].abstain and got[1].strategy == "abstain_with_explanation" and not got[2].abstain and got[2].primary_policy == "pass_through"


def plain_macro(pairs):
    out = []
    for x in ("entailment", "contradiction", "neutral"):
        tp = sum(g == x == p for g, p in pairs)
        fp, fn = sum(g != x and p == x for g, p in pairs), sum(g == x and p != x for g, p in pairs)
        out.append(2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
    return sum(out) / 3


def test_scores_and_intervals(spark):
    rng = random.Random(4)
    labels = ["entailment", "contradiction", "neutral"]
    pairs = [(g := rng.choice(labels), g if rng.random() < 0.7 else rng.choice([*labels, None])) for _ in range(300)]
    df = spark.createDataFrame([(i, g, p, p) for i, (g, p) in enumerate(pairs)], "id int, gold string, predicted string, other string")
    assert abs(df.agg(*M.f1_columns("gold", "predicted")).first().macro_f1 - plain_macro(pairs)) < 1e-6
    low, high = M.interval(M.bootstrap(df, 1000, ["predicted"]), "f1_predicted").first()
    assert low < plain_macro(pairs) < high
    plain = sorted(plain_macro(rng.choices(pairs, k=300)) for _ in range(1000))  # rows resampled one by one
    assert abs(plain[25] - low) < 0.02 and abs(plain[975] - high) < 0.02
    compared = df.withColumn("constant", F.lit("neutral"))
    (r,) = M.significance(compared, "constant", ["predicted"], iterations=400).collect()
    assert r.low < r.delta < r.high and r.p_value < 0.001 and r.stars == "***"
    assert M.bootstrap(df.limit(0), 5, ["predicted"]).where("f1_predicted = 0").count() == 5
    twin = M.bootstrap(df, 20, ["predicted", "other"]).where("f1_predicted <> f1_other")
    assert twin.count() == 0
    gold = df.select(F.col("id").cast("string").alias("sample_id"), "gold")
    predictions = df.select(F.lit("b").alias("baseline"), F.col("id").cast("string").alias("sample_id"), "predicted", F.lit(0).alias("order")).where("id < 200")
    r = M.evaluate(gold, predictions.unionByName(predictions.limit(5).withColumn("order", F.lit(-1)))).first()
    assert r.aligned == 200 and r.missing_rate == round(1 / 3, 6)
    assert {(x.baseline, x.sample_id) for x in M.unaligned(gold, predictions).collect()} == {("b", str(i)) for i in range(200, 300)}
    with pytest.raises(Exception, match="too few aligned"):
        M.evaluate(gold, predictions, least_aligned=0.9).collect()
    a = M.averages(df).first()
    assert a.support == 300 and abs(a.macro_f1 - plain_macro(pairs)) < 1e-3 and abs(a.accuracy - sum(g == p for g, p in pairs) / 300) < 1e-4
    assert tuple(M.averages(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert M.per_label(df).count() == 3 and M.evaluate(gold.limit(0), predictions.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"sample_id": "1"}\n\n{"sample_id": \n', encoding="utf-8")
    lines = R.read_json_lines(spark, str(tmp_path / "a.jsonl"), "sample_id string").collect()
    assert [r.sample_id for r in lines] == ["1", None] and lines[1]._corrupt
    (tmp_path / "b.json").write_text('{"records": [{"sample_id": "r1", "query": "q", "retrieved_chunks": [{"chunk_id": "c", "text": "t", "rank": 1}]}]}')
    r = R.read_retrieval(spark, str(tmp_path / "b.json")).first()
    assert r.sample_id == "r1" and r.retrieved_chunks[0].text == "t"
    (tmp_path / "bodies.csv").write_text('Body ID,articleBody\n1,"a ""quoted""\nbody"\n')
    (tmp_path / "stances.csv").write_text("Headline,Body ID,Stance\nh1,1,agree\nh2,9,Discuss\n")
    pairs = {r.headline: r for r in R.read_pairs_csv(spark, str(tmp_path / "bodies.csv"), str(tmp_path / "stances.csv")).collect()}
    assert pairs["h1"].body == 'a "quoted"\nbody' and pairs["h2"].body == "" and pairs["h2"].nli_label == "neutral"
    raw = spark.createDataFrame([("T_1", "x  y", "k"), (None, "x", "k"), ("U", " ", "k")], "title string, content string, extra string")
    records = R.encyclopedia_records(raw).collect()
    assert len(records) == 1 and records[0].metadata == {"extra": "k"} and records[0].source_name == "Wikipedia" and records[0].source_url.endswith("/T_1")
    evidence = spark.createDataFrame([([[["1", "2", "A"], ["1"]], [["1", "2", "B", "0"], ["1", "2", "A"]]],)], "e array<array<array<string>>>")
    assert evidence.select(R.evidence_titles(F.col("e")).alias("t")).first().t == ["A", "B"]
    status = {r.artifact: r.status for r in R.artifact_status(spark, "/root/testdata/sf0.001", ("documents", "absent")).collect()}
    assert status == {"documents": "ready", "absent": "missing"}
    R.write_json_lines(raw, str(tmp_path / "out"))
    assert R.read_json_lines(spark, str(tmp_path / "out"), "title string").count() == 3


def test_split_and_samples(spark):
    from claimspan.operators import sampling as P

    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    parts = {r.part: r["count"] for r in P.split(df, "id").groupBy("part").count().collect()}
    assert 850 < parts["train"] < 950
    sample = {r.label: r["count"] for r in P.stratified(df, "label", "id", 20).groupBy("label").count().collect()}
    assert sample == {"rare": 10, "common": 10}
    assert P.split(df, "id").exceptAll(P.split(df.repartition(7), "id")).count() == 0
