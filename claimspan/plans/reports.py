"""Queries that report on queries, evidence, rules and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import conflict as K
from ..operators import diagnostics as D
from ..operators import retrieval as R
from ..runtime import table
from . import sql as S
from .search import hygiene_sql
from .typing_sql import ORACLES as TYPED_ORACLES


def query_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_rows").select("sample_id", D.query_bucket(F.col("query")).alias("bucket"))


def query_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Every bucket with its rows and how many have a decisive result; empty buckets are kept."""
    rows = table(spark, folder, "benchmark_rows")
    decisive = F.coalesce(F.exists("cross_source_nli_results", lambda r: r["label"] != "neutral"), F.lit(False))
    counts = rows.groupBy(D.query_bucket(F.col("query")).alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(decisive).alias("decisive"))
    return spark.createDataFrame([(b,) for b in D.BUCKETS], "bucket string").join(F.broadcast(counts), "bucket", "left").na.fill(0)


def _noisy_samples(rows: DataFrame) -> DataFrame:
    """(sample_id, noisy): whether the retrieved evidence has a mean penalty of .12 or a hard flag.

    The table keeps no chunks, so the claims taken from a chunk, in order, stand in for its text. Chunks that gave no
    claim are unknown."""
    claims = rows.select("sample_id", F.posexplode("claims").alias("ord", "c")).where(F.col("c.source_metadata.role") == "retrieved_evidence")
    of_chunk = F.coalesce("c.source_chunk_id", F.concat(F.lit("claim "), "ord")).alias("chunk")
    sentences = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("c.text", F.lit("")).alias("text"))))
    chunks = claims.groupBy("sample_id", F.col("c.source_doc_id").alias("doc"), of_chunk).agg(F.array_join(F.transform(sentences, lambda x: x["text"]), " ").alias("text"))
    assessed = R.hygiene(chunks.withColumn("score", F.lit(0.0)), "score")
    hard = F.arrays_overlap("flags", F.array(F.lit("entity_or_appositive_heavy"), F.lit("ultra_short_non_propositional")))
    return assessed.groupBy("sample_id").agg(((F.round(F.avg("penalty"), 4) >= 0.12) | F.bool_or(hard)).alias("noisy"))


def failure_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without decisive result by failure label. Evidence is noisy by the texts of the row's evidence claims."""
    rows = table(spark, folder, "benchmark_rows")
    asked = F.filter(F.coalesce("claims", F.array().cast(rows.schema["claims"].dataType)), lambda c: c["source_metadata"]["role"] == "query")
    tokens = lambda t: F.size(T.token_list(t))
    n = tokens(F.col("query"))
    bare = lambda c: c["relation"].isNull() & c["object"].isNull()
    decisive = F.coalesce(F.exists("cross_source_nli_results", lambda r: r["label"] != "neutral"), F.lit(False))
    undecided = rows.where(~decisive)
    judged = undecided.select(
        "sample_id", "cross_source_pair_count", D.query_bucket(F.col("query")).alias("bucket"), n.alias("n"),
        F.exists(asked, lambda c: tokens(c["text"]) < 6).alias("short"),
        F.exists(asked, lambda c: bare(c) | ((n >= 7) & (tokens(c["text"]) <= F.greatest(F.lit(4), F.floor(n * 0.6))))).alias("collapsed"),
    )
    label = D.failure_label(F.col("cross_source_pair_count"), F.col("short"), F.col("collapsed"), F.coalesce("noisy", F.lit(False)), F.col("bucket"), F.col("n"))
    return judged.join(_noisy_samples(undecided), "sample_id", "left").groupBy(label.alias("failure"), "bucket").agg(F.count("*").alias("rows"))


def rule_fires(spark: SparkSession, folder: str) -> DataFrame:
    return D.fired_rules(K.typed_pairs(table(spark, folder, "p1_payload")))


def evidence_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return D.evidence_clusters(K.typed_pairs(table(spark, folder, "p1_payload"))).groupBy("payload_id", "cluster").agg(F.count("*").alias("claims"))


def label_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded results: label by dataset, one column a label."""
    rows = table(spark, folder, "benchmark_rows").select("dataset", F.explode("cross_source_nli_results").alias("r"))
    return rows.groupBy("dataset").pivot("r.label", ["entailment", "contradiction", "neutral"]).agg(F.count(F.lit(1))).na.fill(0)


def text_length_deciles(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and ninth decile of text length per language."""
    rows = table(spark, folder, "documents").select("lang", F.length("text").alias("chars"))
    return D.exclusive_percentile(rows, "lang", "chars")


def relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved chunks per record, and how many share a keyword with the query."""
    rows = table(spark, folder, "retrieval_json").select("row_id", "query", F.explode("retrieved_chunks.text").alias("text"))
    return rows.groupBy("row_id").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce(D.relevant(F.col("query"), F.col("text")), F.lit(False))).alias("relevant"))


def answer_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first five texts of each record in rank order, and the documents they come from, sorted."""
    rows = table(spark, folder, "retrieval_json").select("row_id", F.posexplode("retrieved_chunks").alias("i", "c"))
    ranked = rows.select("row_id", F.coalesce("c.rank", F.col("i") + 1).alias("rank"), "i", F.col("c.text").alias("text"), F.col("c.metadata")["source_doc_id"].alias("doc"))
    kept = ranked.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    best = kept.groupBy("row_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "i", "text", "doc"))), 1, 5).alias("top"))
    return best.select("row_id", F.size("top").alias("texts"), F.col("top")[0]["text"].alias("first_text"), F.array_join(F.array_sort(F.array_distinct(F.array_compact("top.doc"))), "|").alias("documents"))


def noisy_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean penalty and share of flagged chunks per exported dataset (metadata of the record)."""
    rows = table(spark, folder, "retrieval_json").select(F.col("metadata")["dataset"].alias("dataset"), F.explode("retrieved_chunks").alias("c"))
    assessed = R.hygiene(rows.select("dataset", F.col("c.text").alias("text"), F.lit(0.0).alias("score")), "score")
    return assessed.groupBy("dataset").agg(
        F.count("*").alias("chunks"), F.sum(F.round(F.col("penalty") * 100).cast("bigint")).alias("penalty_points"), F.count_if(F.size("flags") > 0).alias("flagged")
    )


QUERIES = {
    f.__name__: f
    for f in (query_buckets, query_taxonomy, failure_labels, rule_fires, evidence_clusters, label_crosstab, text_length_deciles, relevance_gate, answer_evidence, noisy_evidence)
}


def _has(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_BUCKET = rf"""case when regexp_matches(q, '["“”]') or {_has("low", D.QUOTE_PHRASES)} then 'quoted_or_attribution_heavy'
  when regexp_matches(' ' || q || ' ', '(?i)[^\p{{L}}\p{{N}}_]({D.MONTHS})[^\p{{L}}\p{{N}}_]') or regexp_matches(' ' || q || ' ', '[^\p{{L}}\p{{N}}_](1[5-9]\d{{2}}|20\d{{2}})[^\p{{L}}\p{{N}}_]') or {_has("low", D.TIME_WORDS)} then 'temporal_query'
  when n <= 6 and caps >= 2 and {_has("low", D.DESCRIPTORS)} then 'ambiguous_name_query' when {_has("low", D.ENTITY_PHRASES)} then 'entity_seeking'
  when n <= 5 then 'very_short_factoid' else 'yes_no_claim_like' end"""
_QUERIES = rf"""b as (select *, {_BUCKET} as bucket from (select *, coalesce(query, '') as q, lower(trim(coalesce(query, ''))) as low,
  len(regexp_extract_all(coalesce(query, ''), '[A-Za-z0-9]+')) as n, len(list_filter(regexp_extract_all(coalesce(query, ''), '[\p{{L}}\p{{N}}_''-]+'), lambda w: regexp_matches(w, '^[A-Z]'))) as caps,
  len(list_filter(coalesce(cross_source_nli_results, []), lambda r: r.label <> 'neutral')) > 0 as decisive from benchmark_rows))"""
_KEYS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') and not list_contains(" + S.strings(V.STOPWORDS_RELEVANCE) + ", w))"
_LISTED = "len(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
ORACLES = {
    "query_buckets": f"with {_QUERIES} select sample_id, bucket from b",
    "query_taxonomy": f"""with {_QUERIES} select t.bucket as bucket, count(b.sample_id) as rows, count(*) filter (where b.decisive) as decisive
        from (select unnest({S.strings(D.BUCKETS)}) as bucket) t left join b on b.bucket = t.bucket group by t.bucket""",
    "evidence_clusters": f"""with {S.SIGNALS}, s as (select payload_id, pair_no, 0 as side, a as claim_id, signal from sig union all select payload_id, pair_no, 1, b, signal from sig),
        f as (select payload_id, claim_id, arg_min(signal, (pair_no, side)) as signal from s where claim_id is not null group by all)
        select payload_id, case signal when 'agreement' then 'support' when 'conflict' then 'oppose' else 'neutral' end as cluster, count(*) as claims from f group by all""",
    "noisy_evidence": f"""with {hygiene_sql("chunks as (select metadata['dataset'] as dataset, c.text as text, 0.0 as score, 1 as rank from (select metadata, unnest(retrieved_chunks) as c from retrieval_json))")}
        select dataset, count(*) as chunks, sum(round(penalty * 100)::bigint)::bigint as penalty_points, count(*) filter (where flags <> '') as flagged from k group by dataset""",
    "failure_labels": f"""with {_QUERIES}, cl as (select sample_id, unnest(claims) as c, unnest(range(len(claims))) as i from benchmark_rows),
        {hygiene_sql("""chunks as (select sample_id, string_agg(coalesce(c.text, ''), ' ' order by i) as text, 0.0 as score, 1 as rank from cl where c.source_metadata.role = 'retrieved_evidence'
          group by sample_id, c.source_doc_id, coalesce(c.source_chunk_id, 'claim ' || i))""")},
        noise as (select sample_id, round(avg(penalty), 4) >= 0.12 or bool_or(f1 or f4) as noisy from k group by sample_id),
        asked as (select sample_id, bool_or(tc < 6) as short, bool_or((c.relation is null and c.object is null) or (n >= 7 and tc <= greatest(4, floor(n * 0.6)))) as collapsed
          from (select cl.*, {_LISTED.format("c.text")} as tc, {_LISTED.format("query")} as n from cl join benchmark_rows using (sample_id) where c.source_metadata.role = 'query') group by sample_id),
        j as (select b.bucket, b.cross_source_pair_count as pairs, {_LISTED.format("b.query")} as n, coalesce(short, false) as short, coalesce(collapsed, false) as collapsed, coalesce(noisy, false) as noisy
          from b left join noise using (sample_id) left join asked using (sample_id) where not decisive)
        select case when pairs = 0 then 'NO_CROSS_SOURCE_SIGNAL' when short and bucket in ('very_short_factoid', 'ambiguous_name_query', 'entity_seeking') then 'Q_SHORT' when collapsed then 'Q_COLLAPSED_IN_P1' when noisy then 'EVIDENCE_STILL_NOISY'
          when bucket in ('ambiguous_name_query', 'entity_seeking') or n <= 7 then 'Q_UNDERSPECIFIED' else 'EVIDENCE_OK_BUT_NOT_COMPARABLE' end as failure, bucket, count(*) as rows from j group by all""",
    "label_crosstab": """select dataset, count(*) filter (where r.label = 'entailment') as entailment, count(*) filter (where r.label = 'contradiction') as contradiction,
        count(*) filter (where r.label = 'neutral') as neutral from (select dataset, unnest(cross_source_nli_results) as r from benchmark_rows) group by dataset""",
    "relevance_gate": f"""select row_id, count(*) as chunks, count(*) filter (where len(kq) = 0 or list_has_any(kq, kt)) as relevant from (
        select row_id, {_KEYS.format("query")} as kq, {_KEYS.format("c.text")} as kt from (select row_id, query, unnest(retrieved_chunks) as c from retrieval_json)) group by row_id""",
    "answer_evidence": """with k as (select row_id, coalesce(c.rank, i + 1) as rank, i, c.text as text, c.metadata['source_doc_id'] as doc from (
          select row_id, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json) where trim(coalesce(c.text, '')) <> ''),
        t as (select *, row_number() over (partition by row_id order by rank, i) as p from k)
        select row_id, count(*)::int as texts, arg_min(text, p) as first_text, coalesce(string_agg(distinct doc, '|' order by doc), '') as documents from t where p <= 5 group by row_id""",
    "text_length_deciles": """with c as (select lang, length(text) as v from documents where text is not null), r as (select lang, v, row_number() over (partition by lang order by v) as k, count(*) over (partition by lang) as n from c),
        a as (select *, least(greatest(floor((n + 1) * 9 / 10.0), 1), greatest(n - 1, 1)) as w, (n + 1) * 9 / 10.0 as x from r)
        select lang, round(avg(v), 4) as mean, round((max(case when k = w then v end) + (max(case when k = least(w + 1, n) then v end) - max(case when k = w then v end)) * max(x - w))::double, 4) as decile from a group by lang""",
}
ORACLES |= {k: v for k, v in TYPED_ORACLES.items() if k in QUERIES}
