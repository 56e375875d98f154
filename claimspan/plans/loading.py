"""Queries over loaders, exports and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import sampling as P
from ..sources import readers as R
from ..runtime import table
from .texts import ANSWERS


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "documents").withColumnRenamed("lang", "language")
    return R.corpus_records(raw.select("doc_id", "text", "title", "language", "topic_key")).select("doc_id", "dataset", "language", F.length("full_text").alias("chars"), F.col("metadata")["topic_key"].alias("topic_key"))


def answer_documents(spark: SparkSession, folder: str) -> DataFrame:
    return R.answer_documents(table(spark, folder, "averitec"))


def answers_as_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.answers_as_chunks(table(spark, folder, "averitec"))


def payload_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = R.validate_payloads(table(spark, folder, "p1_payload"))
    return rejects.select("payload_id", F.array_join("faults", "|").alias("faults"))


def payload_export(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as nested records again: the claim against its answers, in order."""
    rows = table(spark, folder, "averitec")
    answers = R.answers_as_chunks(rows)
    claims = answers.select("sample_id", F.col("rank").alias("ord"), "chunk_id", "text")
    pairs = answers.select("sample_id", F.col("rank").alias("ord"), F.lit("claim").alias("claim_a_id"), F.col("chunk_id").alias("claim_b_id"))
    return R.payload_records(claims, pairs, pairs.where("false")).select("sample_id", F.size("claims").alias("n_claims"), F.col("claims")[0]["chunk_id"].alias("first_claim"), F.size("candidate_pairs").alias("n_pairs"))


def split_claims(spark: SparkSession, folder: str) -> DataFrame:
    return P.split(table(spark, folder, "averitec"), "record_id").select("record_id", "label", "part")


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return P.stratified(table(spark, folder, "averitec"), "label", "record_id", 40).select("record_id", "label")


def distractors(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "retrieval_json").select(F.col("row_id").alias("sample_id"), "retrieved_chunks")
    rows = samples.select("sample_id", F.posexplode("retrieved_chunks").alias("i", "c"))
    chunks = rows.select("sample_id", F.col("c.chunk_id").alias("chunk_id"), F.col("c.text").alias("text"), F.coalesce("c.rank", F.col("i") + 1).alias("rank"))
    pool = table(spark, folder, "document_records").select(F.col("doc_id").alias("chunk_id"), F.col("full_text").alias("text"))
    return P.add_distractors(chunks, pool, 2, samples=samples).groupBy("sample_id").agg(F.count("*").alias("chunks"), F.count_if("distractor").alias("distractors"), F.max("rank").alias("last_rank"))


def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "averitec")
    return rows.groupBy(R.mapped(F.col("label"), V.VERDICT_TO_NLI, "neutral").alias("nli_label"), "split").agg(F.count("*").alias("claims"))


QUERIES = {f.__name__: f for f in (load_corpus, answer_documents, answers_as_chunks, payload_rejects, payload_export, split_claims, stratified_sample, distractors, verdict_counts)}

_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in V.VERDICT_TO_NLI.items())
_CHUNKS = f"""{ANSWERS}, k as (select a.*, v.claim, v.label, row_number() over (partition by record_id order by q_no, a_no)::int as rank
  from answers a join averitec v using (record_id) where trim(coalesce(answer, '')) <> '')"""
ORACLES = {
    "answer_documents": f"""with {ANSWERS} select record_id || ':q' || q_no || ':a' || a_no as doc_id, source_url, source_medium, 'Question: ' || question || chr(10) || 'Answer: ' || trim(answer) as full_text from answers
        where trim(coalesce(answer, '')) <> '' and not contains(lower(answer), 'no answer could be found') and not contains(lower(answer), 'no answer was found')
        union all select record_id || ':justification', null, null, trim(justification) from averitec where trim(coalesce(justification, '')) <> ''""",
    "answers_as_chunks": f"""with {_CHUNKS} select record_id::varchar as sample_id, claim as query, case label {_MAP} else 'neutral' end as label, record_id || ':q' || q_no || ':a' || a_no as chunk_id,
        answer as text, rank, round(1.0 / rank, 4)::double as retrieval_score from k""",
    "load_corpus": """select doc_id::varchar as doc_id, 'generic' as dataset, nullif(trim(lang), '') as language, length(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')), 'x^', ''))::int as chars,
        topic_key from documents where doc_id is not null and trim(coalesce(text, '')) <> ''""",
    "payload_rejects": """with c as (select *, coalesce(claims, []) as cl, list_concat(list_transform(coalesce(candidate_pairs, []), lambda p: p.claim_a_id is null or p.claim_b_id is null),
          list_transform(coalesce(nli_results, []), lambda p: p.claim_a_id is null or p.claim_b_id is null)) as loose from p1_payload),
        i as (select *, list_transform(cl, lambda x: x.claim_id) as ids from c),
        f as (select payload_id, array_to_string(list_filter([case when trim(coalesce(sample_id, '')) = '' then 'no_sample' end,
          case when len(list_filter(ids, lambda x: x is null)) > 0 then 'null_claim_id' end,
          case when len(list_distinct(list_filter(ids, lambda x: x is not null))) < len(list_filter(ids, lambda x: x is not null)) then 'repeated_claim_id' end,
          case when list_contains(loose, true) then 'null_pair_id' end], lambda x: x is not null), '|') as faults from i)
        select * from f where faults <> ''""",
    "payload_export": f"""with {_CHUNKS} select record_id::varchar as sample_id, count(*)::int as n_claims, arg_min(record_id || ':q' || q_no || ':a' || a_no, rank) as first_claim, count(*)::int as n_pairs from k group by record_id""",
    "verdict_counts": f"select case label {_MAP} else 'neutral' end as nli_label, split, count(*) as claims from averitec group by all",
}
