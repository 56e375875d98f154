"""Queries that roll pairs up to samples, build payloads, and compare configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import claims as C
from ..operators import conflict as K
from ..operators import rollups as R
from ..operators import sampling as P
from ..runtime import cut, spread, table
from ..sources import payloads as L
from ..sources import readers as D
from . import sql as S
from .typing_sql import ORACLES as TYPED_ORACLES


def _results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_rows")
    roles = rows.select("sample_id", F.explode("claims").alias("c")).groupBy("sample_id", F.col("c.claim_id").alias("claim_id")).agg(F.first("c.source_metadata.role").alias("role"))
    results = rows.select("sample_id", F.posexplode("cross_source_nli_results").alias("ord", "r"))
    side = lambda x: roles.select("sample_id", F.col("claim_id").alias(f"claim_{x}_id"), F.col("role").alias(f"role_{x}"))
    scores = F.struct(*(F.col(f"r.{x}_score").alias(x) for x in V.NLI_LABELS))
    flat = results.select("sample_id", "ord", "r.claim_a_id", "r.claim_b_id", scores.alias("scores"))
    known = flat.join(side("a"), ["sample_id", "claim_a_id"], "left").join(side("b"), ["sample_id", "claim_b_id"], "left")
    return known.withColumn("cross", R.crosses_sources(F.col("role_a"), F.col("role_b")))


def benchmark_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return R.benchmark_records(_results(spark, folder))


def service_labels(spark: SparkSession, folder: str) -> DataFrame:
    return R.service_labels(table(spark, folder, "benchmark_rows").where("sample_id is not null"), _results(spark, folder))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return K.typed_pairs(table(spark, folder, "p1_payload"))


def signal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.signal_counts(_typed(spark, folder))


def type_maps(spark: SparkSession, folder: str) -> DataFrame:
    return R.type_maps(_typed(spark, folder)).select("payload_id", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("types"))


def stanced_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by stance of the texts, NLI label and the signal that both make."""
    typed = K.typed_pairs(table(spark, folder, "p1_payload"), stance=K.lexical_stance)
    return typed.groupBy("stance", "nli_label", "signal").agg(F.count("*").alias("pairs"))


def answer_plan(spark: SparkSession, folder: str) -> DataFrame:
    plans = R.answer_plans(table(spark, folder, "p1_payload").dropDuplicates(["payload_id"]), _typed(spark, folder))
    return plans.select("payload_id", "query_text", F.size("evidence").alias("texts"), F.try_element_at("evidence", F.lit(1)).alias("first_text"), F.array_join("citations", "|").alias("citations"))


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    """Fact checks with the set of conflict types among their claim and answers."""
    payloads = L.star_payloads(table(spark, folder, "averitec"))
    typed = K.typed_pairs(payloads, "sample_id", stance=K.lexical_stance)
    return R.type_sets(payloads.select("sample_id", "verdict"), typed, "sample_id")


def verdict_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Per verdict: fact checks, and those whose conflict types go with it."""
    judged = _checked(spark, folder).select("verdict", R.aligned(F.col("verdict"), F.col("types")).alias("ok"))
    return judged.where("ok is not null").groupBy("verdict").agg(F.count("*").alias("samples"), F.count_if("ok").alias("aligned"))


def suspicious_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Fact checks by verdict and reason to look at them again."""
    reason = R.suspicion(F.col("verdict"), F.col("types"), F.coalesce("all_last", F.lit(False)))
    return _checked(spark, folder).select("verdict", reason.alias("reason")).where("reason is not null").groupBy("verdict", "reason").agg(F.count("*").alias("samples"))


def star_claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.star_payloads(table(spark, folder, "averitec")).select("sample_id", F.explode("claims").alias("c"))
    return rows.select("sample_id", "c.claim_id", "c.text", "c.time", F.col("c.source_metadata.role").alias("role"), F.col("c.source_metadata.source_medium").alias("source_medium"), F.col("c.source_metadata.question").alias("question"))


def star_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return L.star_payloads(table(spark, folder, "averitec")).select("sample_id", F.inline("candidate_pairs"))


def check_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return L.check_chunks(table(spark, folder, "averitec"), with_questions=True)


def claim_queries(spark: SparkSession, folder: str) -> DataFrame:
    return L.claim_queries(table(spark, folder, "averitec"))


def smoke_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 answer documents of the first 50 claims."""
    records = table(spark, folder, "averitec")
    documents = D.answer_documents(records).withColumn("claim_id", F.split_part("doc_id", F.lit(":"), F.lit(1)).cast("bigint"))
    claims = records.select(F.col("record_id").alias("claim_id")).distinct()
    return L.smoke_slice(claims, documents, 50, 100)[1].select("claim_id", "doc_id")


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieval_json").select("row_id", "query", F.posexplode("retrieved_chunks.text").alias("chunk_no", "text"))
    return spread(rows.select("row_id", "chunk_no", "query", F.coalesce("text", F.lit("")).alias("text")))


def body_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of each retrieved chunk by each way of picking it."""
    rows, out = cut(_chunk_texts(spark, folder)), None
    for mode in L.BODY_MODES[1:]:
        part = L.body_texts(rows, "query", "text", mode).select("row_id", "chunk_no", F.lit(mode).alias("mode"), "evidence")
        out = part if out is None else out.unionByName(part)
    return out


def failure_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """How often each pattern occurs among queries and the best sentences of their chunks."""
    told = L.body_texts(_chunk_texts(spark, folder), "query", "text", "best_sentence")
    return told.select(F.explode(failure_tags(F.col("query"), F.col("evidence"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("chunks"))


def failure_tags(query: F.Column, sentence: F.Column) -> F.Column:
    """All patterns that hold between a query and a sentence: few query words, no or little overlap, numbers or negation that
    differ, quotes or a colon in the query; ``other`` if none does."""
    a, b = T.token_set(query, V.STOPWORDS_HEADLINE), T.token_set(sentence, V.STOPWORDS_HEADLINE)
    shared, numbers = T.size_of_common(a, b), lambda c: F.regexp_extract_all(c, F.lit(r"\b\d+\b"), F.lit(0))
    negated = lambda t: F.arrays_overlap(t, T.words_in(V.HEADLINE_NEGATION))
    tests = (
        ("short_headline", F.size(a) <= 3), ("zero_token_overlap", shared == 0), ("low_token_overlap", (shared > 0) & (shared <= 2)),
        ("number_mismatch", (F.size(numbers(query)) > 0) & ~F.arrays_overlap(numbers(query), numbers(sentence))), ("negation_mismatch", negated(a) != negated(b)),
        ("quoted_headline", query.rlike("['\"]")), ("colon_headline", F.contains(query, F.lit(":"))),
    )
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def _pipeline_counts(chunks: DataFrame, name: str) -> DataFrame:
    """One row of averages over samples of the claim pipeline on chunks (sample_id, chunk_ord, chunk_id, role, text)."""
    claims = cut(C.sentence_claims(chunks, "sample_id")).withColumn("ord", F.struct("chunk_ord", "sent_no"))
    pairs = C.label_pairs(C.candidate_pairs(claims, indexed=True))
    crossing = R.crosses_sources(F.col("role_a"), F.col("role_b"))
    per_sample = pairs.groupBy("sample_id").agg(F.count("*").alias("pairs"), F.count_if(crossing).alias("cross"), F.count_if(crossing & (F.col("label") != "neutral")).alias("decisive"))
    counted = chunks.select("sample_id").distinct().join(claims.groupBy("sample_id").agg(F.count("*").alias("claims")), "sample_id", "left").join(per_sample, "sample_id", "left").na.fill(0)
    share = lambda c: F.round(F.avg((F.col(c) > 0).cast("double")), 4)
    return counted.agg(*(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("claims", "pairs", "cross")), share("cross").alias("cross_coverage"), share("decisive").alias("decisive_coverage")).withColumn("configuration", F.lit(name))


def noise_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """The claim pipeline with and without two foreign passages a sample: averages, coverage and their differences."""
    rows = table(spark, folder, "retrieval_json").withColumn("sample_id", F.col("row_id").cast("string"))
    own = cut(C.chunk_inputs(rows, "sample_id"))
    pool = table(spark, folder, "retrieval_json").select(F.explode("retrieved_chunks").alias("c")).select("c.chunk_id", "c.text").where("trim(coalesce(text, '')) <> ''")
    ranked = own.where("role <> 'query'").select("sample_id", "chunk_id", "text", F.col("chunk_ord").alias("rank"))
    noisy = P.add_distractors(ranked, pool, 2, samples=own.select("sample_id")).where("distractor").select("sample_id", F.col("rank").alias("chunk_ord"), F.concat(F.lit("noise:"), "chunk_id").alias("chunk_id"), F.lit("retrieved_evidence").alias("role"), "text")
    counts = _pipeline_counts(own, "own").unionByName(_pipeline_counts(cut(own.unionByName(noisy)), "noisy"))
    return R.deltas(cut(counts), "configuration", "own", "noisy", ["avg_claims", "avg_pairs", "avg_cross", "cross_coverage", "decisive_coverage"])


def coverage_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved chunks per source document's dataset and threshold: chunks and records with claims, with a pair against the
    query, and with a decisive one."""
    rows = table(spark, folder, "retrieval_json")
    kinds = rows.select("row_id", F.posexplode("retrieved_chunks").alias("i", "c")).select("row_id", (F.col("i") + 1).alias("chunk_ord"), F.coalesce(F.col("c.metadata")["dataset"], F.lit("unknown")).alias("kind"))
    claims = cut(C.sentence_claims(C.chunk_inputs(rows, "row_id"), "row_id")).withColumn("ord", F.struct("chunk_ord", "sent_no"))
    pairs = C.label_pairs(C.candidate_pairs(claims, "row_id", least_lexical=0.05, indexed=True)).where(R.crosses_sources(F.col("role_a"), F.col("role_b")))
    met = pairs.select("row_id", F.greatest("ord_a.chunk_ord", "ord_b.chunk_ord").alias("chunk_ord"), "lexical", "label")
    best = met.groupBy("row_id", "chunk_ord").agg(F.max("lexical").alias("lexical"), F.max(F.when(F.col("label") != "neutral", F.col("lexical"))).alias("decisive"))
    chunks = kinds.join(claims.groupBy("row_id", "chunk_ord").agg(F.count("*").alias("claims")), ["row_id", "chunk_ord"], "left").join(best, ["row_id", "chunk_ord"], "left")
    levels = chunks.withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (0.05, 0.1, 0.2, 0.3)))))
    paired, decisive = F.coalesce(F.col("lexical") >= F.col("threshold"), F.lit(False)), F.coalesce(F.col("decisive") >= F.col("threshold"), F.lit(False))
    return levels.groupBy("kind", "threshold").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("claims") > 0).alias("with_claims"), F.count_if(paired).alias("with_pair"), F.count_if(decisive).alias("decisive"),
        F.count_distinct("row_id").alias("records"), F.count_distinct(F.when(paired, F.col("row_id"))).alias("records_with_pair"), F.count_distinct(F.when(decisive, F.col("row_id"))).alias("records_decisive"),
    )


def model_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Pair-model inputs of the retrieved chunks with their cache keys."""
    rows = _chunk_texts(spark, folder).withColumn("input", T.model_input(F.col("query"), F.col("text"), 40))
    return rows.select("row_id", "chunk_no", "input", T.cache_key(text=F.col("input"), model=F.lit("pair")).alias("cache_key"))


def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded scores through a softmax, in millionths, and the label of the largest."""
    rows = table(spark, folder, "benchmark_rows").select("sample_id", F.posexplode("cross_source_nli_results").alias("ord", "r"))
    powers = rows.select("sample_id", "ord", *(F.exp(f"r.{x}_score").alias(x) for x in V.NLI_LABELS))
    total = F.col("entailment") + F.col("contradiction") + F.col("neutral")
    return powers.select("sample_id", "ord", *(F.floor(F.col(x) / total * 1e6 + 0.5).alias(x) for x in V.NLI_LABELS), C.top_label(F.struct(*V.NLI_LABELS)).alias("label"))


def negation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim with itself less its negating words, and how alike the two are word by word."""
    rows = table(spark, folder, "averitec").select("record_id", F.col("claim").alias("text"), T.without_negation(F.col("claim")).alias("plain"))
    return rows.select("record_id", "plain", (T.word_set(F.col("text")) != T.word_set(F.col("plain"))).alias("negated"))


def embedded_objects(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between the outermost curly brackets of each raw body, by length, and whether it reads as JSON."""
    rows = table(spark, folder, "raw_records").select("record_id", T.json_object(F.col("body")).alias("o"))
    return rows.select("record_id", F.length("o").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        benchmark_rollup, service_labels, signal_counts, type_maps, stanced_fusion, answer_plan, verdict_alignment, suspicious_samples, star_claims, star_pairs, check_chunks, claim_queries, smoke_documents,
        body_modes, failure_patterns, noise_deltas, coverage_by_source, model_inputs, softmax_scores, negation_pairs, embedded_objects,
    )
}

_ROLES = """roles as (select sample_id, c.claim_id as claim_id, c.source_metadata.role as role from (select sample_id, unnest(claims) as c from benchmark_rows)),
r as (select sample_id, i as ord, r.claim_a_id as a, r.claim_b_id as b, r.entailment_score as entailment, r.contradiction_score as contradiction, r.neutral_score as neutral
  from (select sample_id, unnest(cross_source_nli_results) as r, unnest(range(len(cross_source_nli_results)))::int as i from benchmark_rows)),
x as (select r.*, list_sort([ra.role, rb.role]) = ['query', 'retrieved_evidence'] as crossing from r left join roles ra on ra.sample_id = r.sample_id and ra.claim_id = r.a left join roles rb on rb.sample_id = r.sample_id and rb.claim_id = r.b)"""
_BEST = ", ".join(f"coalesce(max({x}) filter (where crossing), 0.0) as best_{x}_score, arg_max(a, ({x}, -ord)) filter (where crossing) as best_{x}_a, arg_max(b, ({x}, -ord)) filter (where crossing) as best_{x}_b" for x in V.NLI_LABELS)
_ANSWERS = """ans as (select record_id, q_no, a_no, question, trim(a.answer) as text, a.source_medium as source_medium from (
  select record_id, q_no, q.question as question, unnest(q.answers) as a, unnest(range(len(q.answers)))::int as a_no from (
    select record_id, unnest(questions) as q, unnest(range(len(questions)))::int as q_no from averitec)) where trim(coalesce(a.answer, '')) <> '')"""
_MEDIUM = "case " + " ".join(f"when regexp_matches(lower(reporting_source), '{pattern}') then '{name}'" for name, pattern in V.REPORTING_SOURCES) + " end"
_VERDICTS = " ".join(f"when '{k}' then '{v}'" for k, v in V.VERDICT_TO_NLI.items())
ORACLES = {
    "benchmark_rollup": f"""with {_ROLES}, s as (select sample_id, count(*) filter (where crossing) as cross_pairs, {_BEST} from x group by sample_id),
        u as (select sample_id, ord, 0 as k, 'entailment' as label, entailment as score from x where crossing union all select sample_id, ord, 1, 'contradiction', contradiction from x where crossing
          union all select sample_id, ord, 2, 'neutral', neutral from x where crossing),
        o as (select sample_id, label from (select *, row_number() over (partition by sample_id order by score desc, ord, k) as p from u) where p = 1)
        select s.*, label as predicted_label from s left join o using (sample_id)""",
    "service_labels": f"""with {_ROLES}, t as (select sample_id, max(entailment) as entailment, max(contradiction) as contradiction, max(neutral) as neutral from x group by sample_id),
        f as (select sample_id, coalesce(entailment, 0.0) as entailment, coalesce(contradiction, 0.0) as contradiction, coalesce(neutral, 1.0) as neutral from (select distinct sample_id from benchmark_rows) left join t using (sample_id))
        select *, case when entailment >= contradiction and entailment >= neutral then 'entailment' when contradiction >= neutral then 'contradiction' else 'neutral' end as predicted_label from f""",
    "signal_counts": f"with {S.SIGNALS} select payload_id, count(*) as pairs, " + ", ".join(f"count(*) filter (where signal = '{s}') as {s}" for s in R.SIGNALS) + " from sig group by payload_id",
    "answer_plan": f"""with {S.SIGNALS}, cl as (select payload_id, list_filter(coalesce(claims, []), lambda c: c is not null) as c from p1_payload),
        e as (select payload_id, c, list_filter(list_transform(list_filter(c, lambda x: x.source_metadata.role = 'retrieved_evidence'), lambda x: x.text), lambda t: trim(coalesce(t, '')) <> '') as texts,
          list_filter(list_transform(c, lambda x: x.source_metadata.source_url), lambda t: trim(coalesce(t, '')) <> '') as urls from cl),
        f as (select payload_id, coalesce(list_filter(c, lambda x: x.source_metadata.role = 'query')[1].text, c[1].text, '') as query_text, texts, urls from e),
        cited as (select payload_id, string_agg(distinct id, '|' order by id) as citations from (select payload_id, unnest([a, b]) as id from prs) where id is not null group by payload_id)
        select payload_id, query_text, (case when len(texts) > 0 then least(len(texts), 5) else len(list_distinct(urls)) end)::int as texts, case when len(texts) > 0 then texts[1] else urls[1] end as first_text,
          coalesce(citations, '') as citations from f left join cited using (payload_id)""",
    "star_claims": f"""with {_ANSWERS} select record_id::varchar as sample_id, 'Q' as claim_id, claim as text, claim_date::varchar as time, 'query' as role, {_MEDIUM} as source_medium, null as question from averitec where coalesce(claim, '') <> ''
        union all select record_id::varchar, 'E' || (row_number() over (partition by record_id order by q_no, a_no) - 1), text, null, 'retrieved_evidence', source_medium, question from ans""",
    "star_pairs": f"with {_ANSWERS} select record_id::varchar as sample_id, 'Q' as claim_a_id, 'E' || (row_number() over (partition by record_id order by q_no, a_no) - 1) as claim_b_id from ans",
    "check_chunks": f"""with {_ANSWERS} select record_id, 'claim' as chunk_id, 'claim' as role, claim as text from averitec union all select record_id, 'answer-' || q_no || '-' || a_no, 'answer', text from ans where q_no < 2 and a_no < 2
        union all select record_id, 'question-' || (i - 1), 'question', q.question from (select record_id, unnest(questions[1:2]) as q, unnest(range(1, len(questions[1:2]) + 1)) as i from averitec) where coalesce(q.question, '') <> ''""",
    "claim_queries": f"select record_id::varchar as claim_id, trim(claim) as query, case label {_VERDICTS} else 'neutral' end as label from averitec where trim(coalesce(claim, '')) <> ''",
    "smoke_documents": f"""with {_ANSWERS}, d as (select record_id as claim_id, record_id || ':q' || q_no || ':a' || a_no as doc_id from ans where not contains(lower(text), 'no answer could be found') and not contains(lower(text), 'no answer was found')
        union all select record_id, record_id || ':justification' from averitec where trim(coalesce(justification, '')) <> ''),
        f as (select distinct record_id from averitec order by record_id limit 50) select claim_id, doc_id from d where claim_id in (select record_id from f) order by doc_id limit 100""",
    "model_inputs": r"""with c as (select row_id, i::int as chunk_no, query, coalesce(c.text, '') as text from (select row_id, query, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json)),
        t as (select row_id, chunk_no, trim(coalesce(query, '')) || ' [SEP] ' || array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:40], ' ') as input from c)
        select *, sha256('{"model":"pair","text":' || to_json(input)::varchar || '}') as cache_key from t""",
    "softmax_scores": f"""with {_ROLES}, p as (select sample_id, ord, exp(entailment) as e, exp(contradiction) as c, exp(neutral) as n from r)
        select sample_id, ord, floor(e / (e + c + n) * 1e6 + 0.5)::bigint as entailment, floor(c / (e + c + n) * 1e6 + 0.5)::bigint as contradiction, floor(n / (e + c + n) * 1e6 + 0.5)::bigint as neutral,
          case when e >= c and e >= n then 'entailment' when c >= n then 'contradiction' else 'neutral' end as label from p""",
    "negation_pairs": rf"""with w as (select record_id, claim, list_filter(regexp_split_to_array(coalesce(claim, ''), '\s+'), lambda w: w <> '') as ws from averitec),
        p as (select record_id, claim, array_to_string(list_filter(ws, lambda w: not list_contains({S.strings(V.KEYWORDS_REFUTE)}, regexp_replace(lower(w), '[^a-z'']', '', 'g'))), ' ') as plain from w),
        s as (select *, list_sort(list_distinct(regexp_extract_all(lower(coalesce(claim, '')), '[\p{{L}}\p{{N}}_]+'))) as a, list_sort(list_distinct(regexp_extract_all(lower(plain), '[\p{{L}}\p{{N}}_]+'))) as b from p)
        select record_id, plain, a <> b as negated from s""",
    "embedded_objects": "select record_id, nullif(length(regexp_extract(body, '(?s)\\{.*\\}')), 0)::int as chars from raw_records",
}
ORACLES |= {k: v for k, v in TYPED_ORACLES.items() if k in QUERIES}
