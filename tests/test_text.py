"""Goldens of the text functions, on literal rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspan.functions import text as T
from claimspan.functions import vocab as V
from claimspan.operators import chunking as C
from claimspan.operators import evidence as E
from claimspan.operators import retrieval as R


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, text, want",
    [
        (T.token_set, "The cat and café1 the CAT", ["cat"]),
        (T.token_set, None, []),
        (T.token_list, "Dr. O'Neil's 3.5% a a", ["dr", "o", "neil", "s", "3", "5", "a", "a"]),
        (T.blank_split, " Not  denied. ", ["not", "denied."]),
        (T.sentences_plain, "One. Two!\n\n Three", ["One.", "Two!", "Three"]),
        (T.sentences_plain, "", []),
        (T.sentences_protected, "Mr. Hest met Dr. Wale vs. Tam. Later.", ["Mr. Hest met Dr. Wale vs. Tam.", "Later."]),
        (T.relevance_keywords, "What is the Toll on those Harbours, and who PAYS the toll?", ["toll", "harbours", "pays"]),
        (T.relevance_keywords, "What is this?", []),
        (T.content_tokens, "Officials approved denies", ["officials", "official", "approved", "approv", "denies", "deni", "denie"]),
        (T.entities, "The Harbour Bank of Tam-X paid A Harbour", ["Bank", "Harbour", "Tam-X"]),
        (T.polarity, "It may not open", "negative"),
        (T.certainty, "It may not open", 0.45),
        (T.first_time, "opened on Feb. 6, 2010 or 2011", "Feb. 6, 2010"),
        (T.is_question, "Who paid?", True),
        (T.is_question, "Whoever paid?", False),
        (T.is_question, "Why it failed", True),
        (T.keyword_label, "It was never true", "contradiction"),
        (T.scored_label, " REFUTES ", "contradiction"),
        (T.scored_label, "n/a", None),
        (T.scored_label, "Odd", "odd"),
        (T.decode_markup, "A_-LRB-b-RRB-  ``c''", 'A (b) "c"'),
        (lambda c: T.first_sentences(c, 2), "A b.  C d. E f.", "A b. C d."),
    ],
)
def test_goldens(spark, function, text, want):
    assert one(spark, function, text) == want


def test_answer_sentences(spark):
    rows = [("What is the population of Broken Bow?", "3,559 people"), ("Who directed Dune?", "D. V."), ("How tall is it?", "9 m."), ("Who is it?", "unknown"), ("", "x")]
    df = spark.createDataFrame(rows, "q string, a string").select(T.answer_sentence(F.col("q"), F.col("a")).alias("s"))
    assert [r.s for r in df.collect()] == ["The population of Broken Bow is 3,559 people.", "Dune was directed by D. V.", "The answer to How tall is it is 9 m.", None, None]


def test_similarities(spark):
    df = spark.createDataFrame([("a b b c", "b b x"), ("", "b"), ("b", None)], "q string, t string").select(
        T.jaccard(T.token_list(F.col("q")), T.token_list(F.col("t"))).alias("j"), T.multiset_overlap(T.token_list(F.col("q")), T.token_list(F.col("t"))).alias("m")
    )
    assert [(round(r.m, 3), r.j if r.m == 0 else None) for r in df.collect()] == [(0.5, None), (0.0, 0.0), (0.0, 0.0)]


def test_window_chunks(spark):
    text = " ".join(f"token{i}" for i in range(1, 31))
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "  ", "x"), (4, "one", "x")], "doc_id int, text string, tokens string")
    rows = C.window_chunks(df, 10, 2).orderBy("doc_id", "chunk_no").collect()
    assert [r.doc_id for r in rows] == [1, 1, 1, 1, 4] and rows[1].chunk.startswith("token9 token10") and rows[3].n_tokens == 6
    with pytest.raises(ValueError):
        C.window_chunks(df, 5, 5)


def test_sentence_groups():
    groups = lambda sizes, *a: C.sentence_groups(np.array(sizes, np.int64), *a).tolist()
    assert groups([6, 6, 6, 6], 12, 20, 2, 1) == [[0, 2], [1, 4]]
    assert groups([200, 5, 5], 12, 20, 2, 0) == [[0, 1], [1, 3]]
    assert groups([], 12, 20, 2, 1) == []
    assert groups([0, 0, 0], 12, 20, 2, 1) == [[0, 3]]
    spans = C.sentence_spans("Dr. Wale met J. Hest. It rained.\n\nNew one here.")
    assert len(spans) == 3


def test_trailing_fragment_goes_to_the_group_before(spark):
    text = "Alpha beta gamma delta runs fast. Second sentence follows here now. Meanwhile."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = C.sentence_chunks(df, 12, 20, 2, 0, least_tokens=4).collect()
    assert [(r.sentence_start, r.sentence_end) for r in rows] == [(0, 2)] and rows[0].chunk == text


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma delta runs. Second sentence follows here now. Third one ends it well. Meanwhile.", "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, chunk string")
    rows = C.sentence_chunks(df, 12, 40, 2, 1, least_tokens=4).collect()
    assert rows[0].char_start == 0 and rows[-1].char_end == len(df.first().text) and {r.doc_id for r in rows} == {"1"}


def test_sentence_ranking_prefers_the_covering_sentence(spark):
    body = "Weather was fine. Alice denied the fake claim, police said. Nothing else happened."
    df = spark.createDataFrame([("Police: 'Alice denied the fake claim'", body, 1), ("x", None, 1), ("x", "", 1)], "h string, b string, ranked_ int")
    first, *rest = E.rank_sentences(df, "h", "b").collect()
    assert first.ranked[0].position == 1 and all(r.ranked == [] for r in rest)
    span = E.best_span(df, "h", "b").collect()
    assert span[0].span.start in (0, 1) and span[1].span is None
    picked = E.mmr_select(df, "h", "b").collect()
    assert picked[0].positions == [1] and picked[1].positions == []  # the others fall below the floor


def test_mmr_against_a_plain_loop(spark):
    body = "The toll bridge opened. The toll bridge opened again. A new harbour toll was set. Cats sleep. The harbour bridge toll rose."
    claim = "harbour bridge toll opened"
    words = lambda s: {w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() if w not in V.STOPWORDS_EVIDENCE}
    sentences = [s.strip() + "." for s in body.split(".") if s.strip()]
    tokens, query = [words(s) for s in sentences], words(claim)
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    relevance = [0.6 * len(query & t) / len(query) + 0.4 * jac(query, t) for t in tokens]
    chosen: list[int] = []
    while len(chosen) < 3:
        free = [i for i in range(len(tokens)) if i not in chosen and (not chosen or relevance[i] >= 0.05)]
        if not free:
            break
        chosen.append(max(free, key=lambda i: (0.7 * relevance[i] - 0.3 * max((jac(tokens[c], tokens[i]) for c in chosen), default=0.0), -i)))
    df = spark.createDataFrame([(claim, body)], "h string, b string")
    assert E.mmr_select(df, "h", "b", k=3).first().positions == sorted(chosen)


CORPUS = [(1, "Cats hunt mice and other prey at night", "A"), (2, "Dogs guard houses", "B"), (3, "Lions hunt prey in groups, lions and cats are related", "C"), (4, None, "D"), (5, "", None), (6, "cats hunt prey", "A")]


def test_search_pipeline(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id int, text string, source string")
    queries = spark.createDataFrame([(10, "cats hunt prey"), (11, ""), (12, None)], "query_id int, query string")
    sparse = R.bm25(queries, corpus, 3)
    got = [(r.query_id, r.doc_id, r["rank"]) for r in sparse.orderBy("rank").collect()]
    assert [g[0] for g in got] == [10, 10, 10] and {g[1] for g in got} == {1, 3, 6}
    assert {r.doc_id for r in R.bm25_local(queries, corpus, 3).collect()} == {1, 3, 6}
    dense = R.nearest(R.hash_vectors(queries, key="query_id", text="query").where("query_id = 10"), R.hash_vectors(corpus), 3)
    assert dense.where("rank = 1").first().doc_id == 6
    fused = R.fuse(sparse, dense, 3).orderBy("rank").collect()
    assert fused[0].doc_id == 6
    hits = sparse.join(corpus, "doc_id").join(queries, "query_id")
    diverse = R.diversify(hits, 2).orderBy("rank").collect()
    assert [r.source_key for r in diverse] == ["A", "C"]
    reranked = R.rerank_lexical(hits, 2).orderBy("rank").collect()
    assert reranked[0].rerank_score == 1.0 and [r["rank"] for r in reranked] == [1, 2]
    assert R.bm25(queries, corpus.limit(0), 3).count() == 0


def test_stored_index_filters_and_blocks(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(*r, {"topic": "x" if r[0] % 2 else "y"}) for r in CORPUS], "doc_id int, text string, source string, metadata map<string,string>")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["cats hunt prey", "lions", "", None, "houses and cats", "zebra"])], "query_id int, query string")
    index = R.build_index(corpus, keep=("source", "metadata"))
    R.write_index(index, str(tmp_path))
    stored, frequencies = R.read_index(spark, str(tmp_path))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    whole = rows(R.bm25(queries, corpus, 3))
    assert rows(R.search_index(queries, stored, 3, frequencies=frequencies)) == whole
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert rows(R.search_index(queries, index, 3)) == whole
    scores = {(q, d): s for q, d, s, _ in whole}
    for filters, kept in (({"source": "A"}, {1, 6}), ({"topic": "y"}, {6}), ({"source": "A", "topic": "x"}, {1}), ({"source": None}, {1, 3, 6})):
        got = rows(R.search_index(queries.where("query_id = 0"), index, 3, filters=filters))
        assert {d for _, d, _, _ in got} == kept and all(scores[q, d] == s for q, d, s, _ in got)  # statistics are unfiltered
    with pytest.raises(ValueError):
        R.search_index(queries, R.build_index(corpus), 3, filters={"source": "A"})
    counted = {(r.token, r.doc_id): (r.tf, r.dl) for r in R.postings(index).collect()}
    assert counted["lions", 3] == (2, 10) and len({d for _, d in counted}) == 4
    assert {r.token: (r.df, r.total) for r in R.token_frequencies(index).collect()}["lions"] == (1, 2)


def test_many_documents_against_plain_bm25(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 40))) for _ in range(700)]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    asked = [" ".join(rng.choices(words, k=6)) for _ in range(7)]
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in R.bm25(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), corpus, 5).collect()}
    tokens = [t.split() for t in texts]
    mean, df = sum(map(len, tokens)) / 700, {w: sum(w in t for t in tokens) for w in words}
    raw = {w: np.log((700 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for w, x in raw.items()}
    for q, query in enumerate(asked):
        score = [sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split()) if t else 0.0 for t in tokens]
        want = sorted(((-np.floor(s * 1e4 + 0.5) / 1e4, d) for d, s in enumerate(score) if set(tokens[d]) & set(query.split())))[:5]
        assert [(d, pytest.approx(-s, abs=1e-4)) for s, d in want] == [got[q, k] for k in range(1, 6)]


def test_pipeline_modes_and_records(spark):
    rows = [(1, "Cats hunt small prey such as mice.", "A", "Cats"), (2, "Dogs are loyal animals that guard houses.", "B", "Dogs"), (3, "Lions are big cats that hunt prey in groups.", "C", "Lions")]
    documents = spark.createDataFrame([(*r, f"202{r[0]}-01-01") for r in rows], "doc_id int, text string, source string, title string, published_at string")
    queries = spark.createDataFrame([(7, "cats hunt prey")], "query_id int, query string")
    index, vectors = R.build_index(documents), R.hash_vectors(documents)
    for mode in ("hybrid", "bm25", "dense"):
        got = R.retrieve(queries, documents, index, vectors, 2, mode, per_source=1).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2] and got[0].title in ("Cats", "Lions") and got[0].source != got[1].source
    recent = R.retrieve(queries, documents, index, vectors, 2, "bm25", rerank=False, prefer_recent=True).collect()
    assert {r.title for r in recent} == {"Cats", "Lions"}
    assert R.retrieve(queries, documents, index, vectors, 2, diverse=False, rerank=False).count() == 2
    (record,) = R.evidence_records(got and R.retrieve(queries, documents, index, vectors, 2), "toy").collect()
    assert record.sample_id == "7" and [c["rank"] for c in record.retrieved_chunks] == [1, 2]
    chunk = record.retrieved_chunks[0]
    assert chunk.source_medium in "AC" and chunk.metadata["title"] in ("Cats", "Lions") and chunk.metadata["dataset"] == "toy"
    with pytest.raises(ValueError):
        R.retrieve(queries, documents, index, vectors, mode="other")
    assert R.retrieve(queries.limit(0), documents, index, vectors, 2).count() == 0


def test_exact_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).round(3)
    vectors[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "doc_id int, vector array<double>")
    asked = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    unit = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    got = {(r.query_id, r["rank"]): r.doc_id for r in R.nearest(asked, df, 4, block=4).collect()}
    for q in range(0, 300, 20):
        cosine = np.floor(unit @ unit[q] * 1e6 + 0.5)
        want = sorted(range(300), key=lambda i: (-cosine[i], i))[:4]
        assert [got[q, k + 1] for k in range(4)] == want


def test_hash_dimensions_are_the_digest(spark):
    digest = hashlib.sha256(b"cat").hexdigest()
    df = spark.createDataFrame([(1, "cat Cat")], "doc_id int, text string")
    row = R.hash_dimensions(df).first()
    assert row.dim == int(digest[:8], 16) % 256 and abs(row.value) == 2


def test_hygiene(spark):
    rows = [(1, "Spider-Man on Disney XD .", 1, 0.9), (1, "The film was released in 1999 by the studio in Rome.", 2, 0.8), (1, None, 3, 0.1), (1, "-LRB- a -RRB- according to no one it is here now", 4, 0.1)]
    df = spark.createDataFrame(rows, "query_id int, text string, rank int, score double")
    got = R.hygiene_order(R.hygiene(df, "score")).orderBy("hygiene_rank").collect()
    assert got[0]["rank"] == 2 and "ultra_short_non_propositional" in next(r for r in got if r["rank"] == 1).flags


def test_plans_stay_native(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id int, text string, source string")
    queries = spark.createDataFrame([(10, "cats hunt prey")], "query_id int, query string")
    plan = R.bm25(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "ArrowEval" not in plan
