"""Benchmark records, plans, payload builders and evidence texts on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from claimspan.functions import text as T
from claimspan.operators import conflict as K
from claimspan.operators import evidence as E
from claimspan.operators import rollups as R
from claimspan.plans.rollups import failure_tags
from claimspan.sources import payloads as L

RESULT = "sample_id string, ord int, claim_a_id string, claim_b_id string, cross boolean, scores struct<entailment: double, contradiction: double, neutral: double>"


def test_benchmark_records_take_the_first_best_pair(spark):
    rows = [
        ("s", 0, "a", "b", True, (0.2, 0.7, 0.1)), ("s", 1, "a", "c", True, (0.7, 0.7, 0.1)), ("s", 2, "a", "d", False, (0.9, 0.9, 0.9)), ("t", 0, "x", "y", False, (0.5, 0.1, 0.4)),
        ("u", 0, "x", "y", True, (0.0, 0.0, 0.0)),
    ]
    got = {r.sample_id: r for r in R.benchmark_records(spark.createDataFrame(rows, RESULT)).collect()}
    s = got["s"]
    assert (s.cross_pairs, s.predicted_label, s.best_contradiction_score, s.best_contradiction_a, s.best_contradiction_b) == (2, "contradiction", 0.7, "a", "b")
    assert (s.best_entailment_b, s.best_neutral_b) == ("c", "b")
    assert got["t"].predicted_label is None and got["t"].best_neutral_score == 0.0 and got["t"].best_neutral_a is None
    assert got["u"].predicted_label == "entailment"
    df = spark.createDataFrame(rows, RESULT)
    labels = {r.sample_id: r for r in R.service_labels(df.select("sample_id").union(spark.createDataFrame([("none",)], "s string")), df).collect()}
    assert labels["s"].predicted_label == "entailment" and labels["none"].predicted_label == "neutral" and labels["none"].neutral == 1.0
    assert R.benchmark_records(df.limit(0)).count() == 0


def test_types_against_verdicts(spark):
    rows = [
        ("Supported", ["none"], False, True, None), ("Supported", ["misinformation"], False, False, "supported but conflicting"), ("Refuted", ["none"], False, False, "refuted but without conflict"),
        ("Refuted", ["hard_contradiction"], True, True, "no rule but the last"), ("Refuted", ["hard_contradiction"], False, True, None),
        ("Conflicting Evidence/Cherrypicking", ["none"], False, False, "conflicting but no conflict found"), ("Not Enough Evidence", [], False, True, "no pairs"),
        ("Not Enough Evidence", ["noise"], False, True, None), ("Not Enough Evidence", ["none"], False, False, None), ("Other", ["none"], False, None, None), (None, ["none"], None, None, None),
    ]
    df = spark.createDataFrame(rows, "verdict string, types array<string>, last boolean, ok boolean, reason string")
    for r in df.select("*", R.aligned(F.col("verdict"), F.col("types")).alias("a"), R.suspicion(F.col("verdict"), F.col("types"), F.col("last")).alias("s")).collect():
        assert (r.a, r.s) == (r.ok, r.reason), r


CHECK = "record_id bigint, claim string, label string, claim_date string, reporting_source string, questions array<struct<question: string, answers: array<struct<answer: string, answer_type: string, source_url: string, source_medium: string, cached_source_url: string>>>>"


def test_star_payloads_and_chunks(spark):
    answers = lambda *texts: [(t, None, "u", "web", None) for t in texts]
    rows = [(1, "The toll fell", "Refuted", "2020", "Facebook post", [("Why?", answers(" a1 ", "", "a3")), (None, None), ("How?", answers("a4"))]), (None, "No key", None, None, None, None), (3, "", "x", None, None, [])]
    df = spark.createDataFrame(rows, CHECK)
    got = {r.sample_id: r for r in L.star_payloads(df).collect()}
    assert len(got) == 2 and len(next(k for k in got if k != "1")) == 10
    one = got["1"]
    assert [c.claim_id for c in one.claims] == ["Q", "E0", "E1", "E2"] and [c.text for c in one.claims[1:]] == ["a1", "a3", "a4"]
    assert one.claims[0].source_metadata.source_medium == "social_media" and [tuple(p) for p in one.candidate_pairs] == [("Q", "E0"), ("Q", "E1"), ("Q", "E2")] and one.nli_results == []
    typed = K.typed_pairs(L.star_payloads(df), "sample_id", stance=K.lexical_stance)
    assert typed.count() == 3 and {r.stance for r in typed.collect()} == {"filtered"}
    chunks = {(r.record_id, r.chunk_id): r.text for r in L.check_chunks(df, with_questions=True).collect()}
    assert chunks[1, "answer-0-0"] == "a1" and (1, "answer-0-2") not in chunks and (1, "answer-2-0") not in chunks and chunks[1, "question-0"] == "Why?"
    assert {r.claim_id for r in L.claim_queries(df).collect()} == {"1", None} - {None} | {None}


def test_question_sets_and_headlines(spark):
    sets = spark.createDataFrame(
        [("s", "What is the population of Broken Bow?", [("It is a town.", "Misinfo", "3,559 people"), ("", "noise", ""), ("The end.", None, "unknown")])],
        "sample_id string, question string, documents array<struct<text: string, type: string, answer: string>>",
    )
    rows = L.question_set_chunks(sets, answer_aware=True).orderBy("rank").collect()
    assert [(r["rank"], r.retrieval_score, r.type) for r in rows] == [(1, 1.0, "misinfo"), (3, pytest.approx(1 / 3), "")]
    assert rows[0].text.endswith("The population of Broken Bow is 3,559 people.") and rows[1].text == "The end."
    pairs = spark.createDataFrame([("p", " Alice denied the claim ", "9", "Rain fell. Alice denied the claim, police said. Cats sleep.", "agree", "entailment"), ("q", "x", "8", "", "discuss", "neutral")], "sample_id string, headline string, body_id string, body string, stance_label string, nli_label string")
    texts = {m: {r.sample_id: r.text for r in L.headline_records(pairs, m).collect()} for m in L.BODY_MODES}
    assert texts["best_sentence"]["p"] == "Alice denied the claim, police said." and texts["top2_span"]["p"] == "Rain fell. Alice denied the claim, police said."
    assert texts["full"]["p"].startswith("Rain") and all(t["q"] == "" for t in texts.values()) and texts["mmr2"]["p"].startswith("Alice")
    with pytest.raises(ValueError):
        L.headline_records(pairs, "other")
    stances = spark.createDataFrame([("h", None, " Agree"), ("h", "b", "maybe"), (None, "b", None)], "headline string, body string, label string")
    assert [tuple(r) for r in L.known_stances(stances).collect()] == [("h", "", "agree")]
    raw = spark.createDataFrame([("1", "refuted", "0.5"), ("2", None, "high")], "sample_id string, prediction string, score string")
    assert [tuple(r) for r in L.read_predictions(raw).collect()] == [("1", "refuted", 0.5), ("2", None, None)]


def test_span_against_a_plain_loop(spark):
    rng = random.Random(7)
    words = "harbour toll council set bridge cats sleep rain fell".split()
    bodies = [" ".join(" ".join(rng.choices(words, k=rng.randint(1, 6))).capitalize() + "." for _ in range(rng.randint(0, 7))) for _ in range(60)]
    rows = [(i, "Council set harbour toll", b) for i, b in enumerate(bodies)] + [(99, "Council set harbour toll", None)]
    df = spark.createDataFrame(rows, "i int, h string, b string")
    scores = {r.i: {x.position: x.score for x in r.ranked} for r in E.rank_sentences(df, "h", "b").collect()}
    asked = {"council", "set", "harbour", "toll"}
    for n in (2, 3):
        got = {r.i: r.span for r in E.evidence_span(df, "h", "b", n).collect()}
        assert got[99] == ""
        for i, _, body in rows[:-1]:
            told = [x.strip() + "." for x in body.split(".") if x.strip()]
            best = (-1.0, 0, 0)
            for k in range(len(told) - n + 1):
                held = {w.strip(".").lower() for x in told[k : k + n] for w in x.split()}
                score = sum(scores[i].get(j, 0.0) for j in range(k, k + n)) + 0.25 * len(asked & held) / 4 + 0.15 * len(asked & held) / len(asked | held)
                if score > best[0] + 1e-12:
                    best = score, k, len(asked & held)
            start = 0 if len(told) <= n or best[0] < 0.2 or best[2] == 0 else best[1]
            assert got[i] == " ".join(told if len(told) <= n else told[start : start + n]), (told, best)
    short = spark.createDataFrame([("Council set harbour toll", "Cats sleep. Dogs bark. Birds fly."), ("Council", "Rain. The council met.")], "h string, b string")
    assert [r.sentence for r in E.best_sentence(short, "h", "b").collect()] == ["Cats sleep.", "The council met."]


def test_text_helpers(spark):
    df = spark.createDataFrame([("It is not a  fake, never!", 'x {"a": {"b": 1}} y'), (None, None), ("", "{")], "t string, j string")
    rows = df.select(T.first_tokens(F.col("t"), 3).alias("f"), T.without_negation(F.col("t")).alias("n"), T.json_object(F.col("j")).alias("o"), T.model_input(F.col("t"), F.col("j"), 2).alias("m"), T.cache_key(b=F.col("t"), a=F.lit(1)).alias("k")).collect()
    assert [(r.f, r.n, r.o) for r in rows] == [("It is not", "It is a", '{"a": {"b": 1}}'), ("", "", None), ("", "", None)]
    assert rows[0].m == 'It is not a  fake, never! [SEP] x {"a":' and len({r.k for r in rows}) == 3
    assert df.select(T.word_set(F.col("t")).alias("w")).first().w == ["it", "is", "not", "a", "fake", "never"]


def test_failure_tags(spark):
    rows = [("Toll not set in 1990: 'why'", "The toll was set in 1991.", {"number_mismatch", "negation_mismatch", "quoted_headline", "colon_headline", "low_token_overlap"}), ("a b", "", {"short_headline", "zero_token_overlap"}), ("Harbour toll rises again today", "Harbour toll rises again today", {"other"})]
    df = spark.createDataFrame([r[:2] for r in rows], "q string, s string").select(failure_tags(F.col("q"), F.col("s")).alias("t"))
    assert [set(r.t) for r in df.collect()] == [r[2] for r in rows]
