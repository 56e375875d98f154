"""Records of fact checks, question sets and headline pairs as the inputs of the claim pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import evidence as E
from ..operators.conflict import medium
from .readers import mapped, read_json_lines

BODY_MODES = ("full", "best_sentence", "top2_span", "top3_span", "mmr2", "mmr3")
QUESTION_SET = "question string, gold_answers array<string>, wrong_answers array<string>, disambig_entity string, documents array<struct<text: string, type: string, answer: string>>"


def claim_queries(records: DataFrame, key: str = "record_id", claim: str = "claim", label: str = "label") -> DataFrame:
    """(claim_id, query, label): claims with text as retrieval queries."""
    text = F.trim(F.coalesce(claim, F.lit("")))
    return records.where(text != "").select(F.col(key).cast("string").alias("claim_id"), text.alias("query"), mapped(F.col(label), V.VERDICT_TO_NLI, "neutral").alias("label"))


def claims_with_titles(raw: DataFrame) -> DataFrame:
    """(claim_id, query, label, evidence_titles) of claim records (id, claim, label, evidence); those without id or claim are
    left out, titles are distinct in order of evidence."""
    from .readers import evidence_titles

    return raw.where(F.col("id").isNotNull() & (F.trim(F.coalesce("claim", F.lit(""))) != "")).select(
        F.col("id").cast("string").alias("claim_id"), F.trim("claim").alias("query"), "label", evidence_titles(F.col("evidence")).alias("evidence_titles")
    )


def _answers(records: DataFrame, key: str) -> DataFrame:
    rows = records.select(key, F.posexplode("questions").alias("q_no", "q")).select(key, "q_no", "q.question", F.posexplode("q.answers").alias("a_no", "a"))
    return rows.where(F.trim(F.coalesce("a.answer", F.lit(""))) != "").select(key, "q_no", "a_no", "question", F.trim("a.answer").alias("text"), F.col("a.source_url").alias("source_url"), F.col("a.source_medium").alias("source_medium"))


def check_chunks(records: DataFrame, key: str = "record_id", questions: int = 2, answers: int = 2, with_questions: bool = False) -> DataFrame:
    """(key, chunk_id, role, text): the claim, then of the first questions their first answers that are not empty (counted
    before empty ones are left out), and the questions themselves if wanted."""
    claim = records.select(key, F.lit("claim").alias("chunk_id"), F.lit("claim").alias("role"), F.col("claim").alias("text"))
    held = _answers(records, key).where((F.col("q_no") < questions) & (F.col("a_no") < answers))
    out = claim.unionByName(held.select(key, F.concat(F.lit("answer-"), "q_no", F.lit("-"), "a_no").alias("chunk_id"), F.lit("answer").alias("role"), "text"))
    if with_questions:
        asked = records.select(key, F.posexplode(F.slice("questions.question", 1, questions)).alias("q_no", "text")).where(F.coalesce("text", F.lit("")) != "")
        out = out.unionByName(asked.select(key, F.concat(F.lit("question-"), "q_no").alias("chunk_id"), F.lit("question").alias("role"), "text"))
    return out


def star_payloads(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Payloads (sample_id, claims, candidate_pairs, nli_results) of fact checks: the claim Q against every answer E0, E1, ...
    that is not empty; results are empty. A record without key is named by a hash of its claim, one without claim left out.

    The medium of the claim is inferred from its reporting source. Answers are gathered per record."""
    have = set(records.columns)
    named = F.coalesce(F.col(key).cast("string"), F.substring(F.sha1("claim"), 1, 10)) if key in have else F.substring(F.sha1("claim"), 1, 10)
    rows = records.where(F.coalesce("claim", F.lit("")) != "").withColumn("sample_id", named)
    listed = F.flatten(
        F.transform(
            F.coalesce("questions", F.array().cast(records.schema["questions"].dataType)),
            lambda q: F.transform(F.coalesce(q["answers"], F.array()), lambda a: F.struct(q["question"].alias("question"), F.trim(a["answer"]).alias("text"), a["source_url"].alias("source_url"), a["source_medium"].alias("source_medium"))),
        )
    )
    none = F.lit(None).cast("string")

    def claim(claim_id: Column, text: Column, time: Column, role: str, url: Column, kind: Column, reporting: Column, date: Column, question: Column) -> Column:
        source = F.struct(
            F.lit(role).alias("role"), url.alias("source_url"), kind.alias("source_medium"), reporting.alias("reporting_source"), date.alias("claim_date"), question.alias("question"), F.lit(None).cast("double").alias("authority")
        )
        slots = [F.lit(None).cast("string").alias(n) for n in ("subject", "relation", "object", "qualifier")]
        return F.struct(claim_id.alias("claim_id"), text.alias("text"), *slots, time.alias("time"), source.alias("source_metadata"))

    date, reporting = F.col("claim_date").cast("string"), F.col("reporting_source")
    query = claim(F.lit("Q"), F.col("claim"), date, "query", none, F.nullif(medium(none, reporting), F.lit("")), reporting, date, none)
    held = rows.withColumn("_answers", F.filter(listed, lambda a: F.coalesce(a["text"], F.lit("")) != ""))
    evidence = F.transform("_answers", lambda a, i: claim(F.concat(F.lit("E"), i), a["text"], none, "retrieved_evidence", a["source_url"], a["source_medium"], none, none, a["question"]))
    pairs = F.transform("_answers", lambda a, i: F.struct(F.lit("Q").alias("claim_a_id"), F.concat(F.lit("E"), i).alias("claim_b_id")))
    nothing = F.array().cast("array<struct<claim_a_id: string, claim_b_id: string, label: string>>")
    return held.select("sample_id", F.concat(F.array(query), evidence).alias("claims"), pairs.alias("candidate_pairs"), nothing.alias("nli_results"), F.col("label").alias("verdict"))


def read_question_sets(spark: SparkSession, path: str) -> DataFrame:
    """Question sets as retrieval records, numbered by line: (sample_id, query, chunk_id, text, rank, retrieval_score, type,
    answer). The rank counts documents before those without text are left out; the score is its inverse."""
    lines = read_json_lines(spark, path, QUESTION_SET).withColumn("line", F.monotonically_increasing_id())
    return question_set_chunks(lines.withColumn("sample_id", F.concat(F.lit("set:"), "line")))


def question_set_chunks(sets: DataFrame, answer_aware: bool = False) -> DataFrame:
    """The same of sets with a sample_id. ``answer_aware`` appends the sentence that a document's answer stands for."""
    rows = sets.select("sample_id", F.trim(F.coalesce("question", F.lit(""))).alias("query"), F.posexplode("documents").alias("i", "d"))
    text, answer = F.trim(F.coalesce("d.text", F.lit(""))), F.trim(F.coalesce("d.answer", F.lit("")))
    said = T.answer_sentence(F.col("query"), answer)
    whole = F.when(said.isNotNull() & ~F.contains(text, said), F.concat(text, F.lit(" "), said)).otherwise(text) if answer_aware else text
    return rows.where(text != "").select(
        "sample_id", "query", F.concat("sample_id", F.lit(":doc"), "i").alias("chunk_id"), whole.alias("text"), (F.col("i") + 1).alias("rank"), (1 / (F.col("i") + 1)).alias("retrieval_score"),
        F.lower(F.trim(F.coalesce("d.type", F.lit("")))).alias("type"), answer.alias("answer"),
    )


def body_texts(rows: DataFrame, headline: str, body: str, mode: str, out: str = "evidence") -> DataFrame:
    """Adds the part of the body that stands for it: all of it, its best sentence, its best span of two or three, or two or
    three sentences by maximal marginal relevance."""
    if mode not in BODY_MODES:
        raise ValueError(f"mode must be one of {BODY_MODES}, not {mode!r}")
    if mode == "full":
        return rows.withColumn(out, F.trim(F.coalesce(body, F.lit(""))))
    if mode == "best_sentence":
        return E.best_sentence(rows, headline, body, out)
    if mode.endswith("_span"):
        return E.evidence_span(rows, headline, body, int(mode[3]), out)
    picked = E.mmr_select(rows, headline, body, int(mode[3]), out="_positions")
    sentences = T.sentences_plain(F.col(body))
    joined = F.array_join(F.transform("_positions", lambda i: F.element_at(sentences, i + 1)), " ")
    return picked.withColumn(out, F.coalesce(joined, F.lit(""))).drop("_positions")


def headline_records(pairs: DataFrame, mode: str = "top2_span") -> DataFrame:
    """(sample_id, query, label, chunk_id, text, rank, retrieval_score) of headline and body pairs (see read_pairs_csv)."""
    told = body_texts(pairs, "headline", "body", mode, "text")
    return told.select("sample_id", F.trim("headline").alias("query"), F.col("nli_label").alias("label"), F.concat(F.lit("body:"), "body_id").alias("chunk_id"), "text", F.lit(1).alias("rank"), F.lit(1.0).alias("retrieval_score"))


def known_stances(rows: DataFrame, headline: str = "headline", body: str = "body", label: str = "label") -> DataFrame:
    """Rows whose label, in lower case, is one of the four stances; null texts are empty."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return rows.withColumns({headline: F.coalesce(headline, F.lit("")), body: F.coalesce(body, F.lit("")), label: low}).where(low.isin(*V.STANCE_TO_NLI))


def read_predictions(raw: DataFrame) -> DataFrame:
    """(sample_id, predicted, score) from loosely named columns: predicted_label or prediction; a score that is no number is
    null."""
    have = set(raw.columns)
    pick = [F.col(c).cast("string") for c in ("predicted_label", "prediction") if c in have]
    score = F.col("score").try_cast("double") if "score" in have else F.lit(None).cast("double")
    return raw.select("sample_id", F.coalesce(*pick, F.lit(None).cast("string")).alias("predicted"), score.alias("score"))


def smoke_slice(claims: DataFrame, documents: DataFrame, claims_kept: int, documents_kept: int, key: str = "claim_id", document: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The first claims by key and, of the documents that belong to them, the first by key: a small slice to try things on."""
    few = claims.orderBy(key).limit(claims_kept)
    return few, documents.join(few.select(key).distinct(), key, "left_semi").orderBy(document).limit(documents_kept)
