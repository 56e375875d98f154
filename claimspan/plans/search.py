"""Retrieval queries: every averitec claim whose record_id is divisible by 20 against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import retrieval as R
from ..runtime import cut, table
from . import sql as S

TOP, CANDIDATES, EXTRA = 8, 24, 5


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "averitec").where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), F.col("claim").alias("query"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source", "lang", "title", "published_at")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25(_queries(spark, folder), _documents(spark, folder), TOP)


def bm25_local(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25_local(_queries(spark, folder), _documents(spark, folder), TOP)


def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    return R.hash_dimensions(_documents(spark, folder))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding whose id is divisible by 20 with its 5 nearest."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return R.nearest(queries, vectors, 5, "vec_id").select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


def _dense_hash(spark: SparkSession, folder: str) -> DataFrame:
    asked = R.hash_vectors(_queries(spark, folder), key="query_id", text="query", unit=False)
    return R.nearest(asked, R.hash_vectors(_documents(spark, folder), unit=False), CANDIDATES)


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    sparse = R.bm25(_queries(spark, folder), _documents(spark, folder), CANDIDATES)
    return R.fuse(sparse, _dense_hash(spark, folder), TOP)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    hits = R.bm25(_queries(spark, folder), _documents(spark, folder), CANDIDATES)
    return hits.join(_queries(spark, folder), "query_id").join(_documents(spark, folder), "doc_id")


def minmax_norm(spark: SparkSession, folder: str) -> DataFrame:
    hits = R.bm25(_queries(spark, folder), _documents(spark, folder), CANDIDATES)
    return hits.select("query_id", "doc_id", F.floor(R.min_max("score") * 10_000 + 0.5).alias("scaled"))


def rerank_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return R.rerank_lexical(_candidates(spark, folder), TOP).select("query_id", "doc_id", "rerank_score", "pre_rerank_rank", "rank")


def diversify(spark: SparkSession, folder: str) -> DataFrame:
    return R.diversify(_candidates(spark, folder), TOP)


def filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same over documents in English alone; word statistics stay those of all documents."""
    index = R.build_index(_documents(spark, folder), keep=("lang",))
    return R.search_index(_queries(spark, folder), index, TOP, filters={"lang": "en"})


def _retrieved(spark: SparkSession, folder: str, top_k: int, diverse: bool) -> DataFrame:
    documents = _documents(spark, folder).dropDuplicates(["doc_id"])
    return R.retrieve(_queries(spark, folder), documents, R.build_index(documents), cut(R.hash_vectors(documents, unit=False)), top_k, diverse=diverse, pool=CANDIDATES)


def retrieve_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid candidates, re-ranked and diversified: the best TOP of every query."""
    return _retrieved(spark, folder, TOP, True).select("query_id", "doc_id", F.col("score").alias("rerank_score"), F.col("rank").cast("int").alias("rank"))


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = R.hygiene_order(R.hygiene(_retrieved(spark, folder, TOP + EXTRA, False), "score"))
    return R.diversified(cleaned.drop("rank").withColumnRenamed("hygiene_rank", "rank"), TOP, 2, 2)


def handoff_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence as it is handed on: EXTRA candidates more, cleaned by hygiene, then diversified; one row a chunk of the
    nested records."""
    records = R.evidence_records(_exported(spark, folder), "documents")
    rows = records.select("sample_id", "metadata", F.explode("retrieved_chunks").alias("c"))
    return rows.select(
        "sample_id", F.col("metadata")["dataset"].alias("dataset"), F.col("c.rank").cast("int").alias("rank"), "c.chunk_id", "c.retrieval_score", "c.source_medium",
        F.col("c.metadata")["source_doc_id"].alias("source_doc_id"), F.col("c.metadata")["title"].alias("title"),
    )


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieval_json").select(F.col("row_id").alias("query_id"), "query", F.posexplode("retrieved_chunks").alias("chunk_no", "c"))
    return rows.select("query_id", "query", "chunk_no", F.col("c.chunk_id").alias("chunk_id"), F.col("c.text").alias("text"), F.coalesce("c.rank", F.col("chunk_no") + 1).alias("rank"), F.coalesce("c.retrieval_score", F.lit(0.0)).alias("score"))


def hygiene_scores(spark: SparkSession, folder: str) -> DataFrame:
    assessed = R.hygiene(_chunks(spark, folder), "score")
    return assessed.select("query_id", "chunk_no", F.array_join("flags", "|").alias("flags"), "penalty", F.col("skip").alias("skipped"))


def hygiene_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return R.hygiene_order(R.hygiene(_chunks(spark, folder), "score")).select("query_id", "chunk_no", "adjusted_score", "hygiene_rank")


def retrieval_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Over all exported records: share whose first five chunks hold a document of the record's evidence (that of its chunk
    of the best score), mean number of different documents among them, and mean score (all in ten-thousandths)."""
    chunks = _chunks(spark, folder).withColumn("doc", F.split_part("chunk_id", F.lit("::"), F.lit(1)))
    gold = chunks.groupBy("query_id").agg(F.max_by("doc", F.struct("score", -F.col("chunk_no"))).alias("gold"))
    top = chunks.where(F.col("rank") <= 5).groupBy("query_id").agg(F.collect_set("doc").alias("docs"), F.avg("score").alias("score"))
    judged = gold.join(top, "query_id", "left")
    parts = lambda c: F.floor(F.avg(c) * 10_000 + 0.5)
    return judged.agg(
        F.count("*").alias("queries"), parts(F.coalesce(F.array_contains("docs", F.col("gold")), F.lit(False)).cast("double")).alias("recall_at_5"),
        parts(F.coalesce(F.size("docs"), F.lit(0)).cast("double")).alias("documents_at_5"), parts(F.round("score", 9)).alias("mean_score"),
    )


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_local, hash_embed, dense_topk, hybrid_topk, minmax_norm, rerank_lexical, diversify, filtered_topk, retrieve_pipeline, handoff_chunks, hygiene_scores, hygiene_rerank, retrieval_recall)
}

_INDEX = f"""
toks as (select doc_id, len(t) as dl, unnest(t) as token from (select doc_id, {S.token_list("text")} as t from documents)),
idx as (select token, doc_id, count(*) as tf, any_value(dl) as dl from toks group by token, doc_id),
stats as (select count(*) as n, avg(len({S.token_list("text")})) as avgdl from documents),
qt as (select query_id, token, count(*) as qtf from (select record_id as query_id, unnest({S.token_list("claim")}) as token from averitec where record_id % 20 = 0) group by all)"""
_BM25 = f"""{_INDEX},
raw as (select token, ln((n - df + 0.5) / (df + 0.5)) as r from (select token, count(*) as df from idx group by token), stats),
idf as (select token, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
scored as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as score from idx join qt using (token) join idf using (token), stats group by all),
hits as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from scored)"""
CHUNKS = """chunks as (select row_id as query_id, query, i::int as chunk_no, c.chunk_id as chunk_id, c.text as text, coalesce(c.rank, i + 1)::int as rank, coalesce(c.retrieval_score, 0.0) as score
  from (select row_id, query, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json))"""


def hygiene_sql(source: str) -> str:
    count = lambda m: f"(length(t) - length(replace(t, '{m}', '')))"
    markers = " + ".join(f"{count(m)} / {len(m)}.0" for m in V.MARKER_TOKENS)
    starts = " or ".join(f"starts_with(lower(t), '{p}')" for p in V.ATTRIBUTION_PREFIXES)
    return f"""{source},
m as (select *, {S.token_list("t")} as tk from (select *, trim(coalesce(text, '')) as t from chunks)),
f as (select *, len(tk) as n, len(list_filter(tk, lambda w: list_contains({S.strings(V.VERB_HINTS)}, w))) as verbs, {count(",")} as commas, {markers} as marks from m),
g as (select *, n < 6 and verbs = 0 as f1, marks >= 2 or marks / greatest(n, 1) >= 0.12 as f2, ({starts}) as f3, verbs = 0 and commas >= 2 and n <= 14 as f4 from f),
h as (select *, least(round(0.55 * f1::int + 0.2 * f2::int + 0.15 * f3::int + 0.25 * f4::int, 4), 1.0)::double as penalty,
  array_to_string(list_filter([case when f1 then 'ultra_short_non_propositional' end, case when f2 then 'parenthetical_heavy' end,
    case when f3 then 'attribution_or_appositive_heavy' end, case when f4 then 'entity_or_appositive_heavy' end], lambda x: x is not null), '|') as flags from g),
k as (select *, round(score - 0.35 * penalty, 6) as adjusted_score, penalty >= 0.85 and (f1 or f4) as skipped from h)"""


_HASHED = """select {id}, dim, sum(sign)::double as value from (
        select {id}, (('0x' || h[1:8])::bigint % 256)::int as dim, case when ('0x' || h[9:10])::int % 2 = 0 then 1 else -1 end as sign
        from (select {id}, sha256(token) as h from (select {id}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) as token from {source}))) group by all having sum(sign) <> 0"""


def _hybrid_sql(pool: int) -> str:
    """top (query_id, doc_id, score, dense_rank, sparse_rank, rank): the ``pool`` best by fused scores of hits and nearest hash
    vectors, each ``pool`` long."""
    scaled = lambda name: f"(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end) as {name}"
    return f"""{_BM25},
qs as (select record_id as query_id, claim from averitec where record_id % 20 = 0), ds as (select distinct on (doc_id) doc_id, text, source, title, lang from documents),
hq as ({_HASHED.format(id="query_id", text="claim", source="qs")}), hd as ({_HASHED.format(id="doc_id", text="text", source="ds")}),
nq as (select query_id, sqrt(sum(value * value)) as n from hq group by query_id), nd as (select doc_id, sqrt(sum(value * value)) as n from hd group by doc_id),
dots as (select query_id, doc_id, sum(hq.value * hd.value) as dot from hq join hd using (dim) group by all),
cosine as (select q.query_id, d.doc_id, floor(coalesce(dot / (nq.n * nd.n), 0) * 1e6 + 0.5) / 1e6 as score from qs q cross join ds d
  left join dots on dots.query_id = q.query_id and dots.doc_id = d.doc_id left join nq on nq.query_id = q.query_id left join nd on nd.doc_id = d.doc_id),
near as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from cosine) where rank <= {pool}),
sp as (select query_id, doc_id, rank as sparse_rank, {scaled("sparse")} from (select * from hits where rank <= {pool}) window w as (partition by query_id)),
de as (select query_id, doc_id, rank as dense_rank, {scaled("dense")} from near window w as (partition by query_id)),
fused as (select query_id, doc_id, coalesce(sparse, 0) as sparse, coalesce(dense, 0) as dense, round(0.55 * coalesce(dense, 0) + (1 - 0.55) * coalesce(sparse, 0), 6) as score, sparse_rank, dense_rank
  from sp full join de using (query_id, doc_id)),
top as (select * from (select *, row_number() over (partition by query_id order by score desc, sparse_rank nulls last, dense_rank nulls last) as rank from fused) where rank <= {pool})"""


def _reranked_sql(pool: int) -> str:
    """re (query_id, doc_id, source, title, text, score, rank): the candidates by lexical overlap."""
    return f"""{_hybrid_sql(pool)},
overlap as (select t.query_id, t.doc_id, coalesce(sum(least(qtf, tf)), 0)::double / any_value(n) as lexical from top t join (select query_id, sum(qtf) as n from qt group by query_id) using (query_id)
  left join (select qt.query_id, idx.doc_id, qtf, tf from qt join idx using (token)) m on m.query_id = t.query_id and m.doc_id = t.doc_id group by all),
re as (select t.query_id, t.doc_id, source, title, text, case when lexical <> 0 then lexical when t.score <> 0 then t.score when dense <> 0 then dense else sparse end as score,
  row_number() over (partition by t.query_id order by coalesce(lexical, 0) desc, t.rank) as rank from top t left join overlap using (query_id, doc_id) join ds using (doc_id))"""


def _diverse_sql(source: str, k: int) -> str:
    """Diversified rows (query_id, doc_id, source, title, text, score, rank) of ``source`` with the columns of re: one
    document of each of the two sources that come first, then the rest in order, two a source."""
    return f"""ordered as (select *, row_number() over (partition by query_id order by score desc, rank) as place, coalesce(source, doc_id::varchar) as src from {source}),
within_source as (select *, row_number() over (partition by query_id, src order by place) as nth from ordered),
firsts as (select *, nth = 1 and row_number() over (partition by query_id, nth order by place) <= 2 as early from within_source),
diverse as (select query_id, doc_id, source, title, text, score, rank from (select * exclude (rank), row_number() over (partition by query_id order by early desc, place)::int as rank from firsts where nth <= 2) where rank <= {k})"""


ORACLES = {
    "bm25_topk": f"with {_BM25} select query_id, doc_id, score, rank from hits where rank <= {TOP}",
    "bm25_local": f"""with {_INDEX}, scored as (select query_id, doc_id, round(sum(ln((dl - tf + 0.5) / (tf + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as score
        from idx join qt using (token), stats group by all)
        select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from scored) where rank <= {TOP}""",
    "hash_embed": """select doc_id, dim, sum(sign)::bigint as value from (
        select doc_id, (('0x' || h[1:8])::bigint % 256)::int as dim, case when ('0x' || h[9:10])::int % 2 = 0 then 1 else -1 end as sign
        from (select doc_id, sha256(token) as h from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as token from documents)))
        group by all having sum(sign) <> 0""",
    "dense_topk": """select query_id, vec_id, rank from (select q.vec_id as query_id, v.vec_id as vec_id,
          row_number() over (partition by q.vec_id order by floor(list_cosine_similarity(q.e, v.e) * 1e6 + 0.5) desc, v.vec_id)::int as rank
        from (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0) q, (select vec_id, embedding::double[] as e from embeddings) v) where rank <= 5""",
    "minmax_norm": f"""with {_BM25}, top as (select * from hits where rank <= {CANDIDATES}), m as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from top)
        select query_id, doc_id, floor((case when hi = lo then 1.0 else (score - lo) / (hi - lo) end) * 10000 + 0.5)::bigint as scaled from m""",
    "rerank_lexical": f"""with {_BM25}, top as (select * from hits where rank <= {CANDIDATES}),
        shared as (select h.query_id, h.doc_id, any_value(h.rank) as pre_rerank_rank, sum(least(qtf, coalesce(tf, 0)))::double / sum(qtf) as rerank_score
          from top h join qt using (query_id) left join idx on idx.token = qt.token and idx.doc_id = h.doc_id group by all)
        select * from (select *, row_number() over (partition by query_id order by rerank_score desc, pre_rerank_rank)::int as rank from shared) where rank <= {TOP}""",
    "hybrid_topk": f"""with {_hybrid_sql(CANDIDATES)} select query_id, doc_id, score, sparse, dense, rank::int as rank from top where rank <= {TOP}""",
    "diversify": f"""with {_BM25}, re as (select h.query_id, h.doc_id, d.source, d.title, d.text, h.score, h.rank from hits h join documents d using (doc_id) where rank <= {CANDIDATES}),
        {_diverse_sql("re", TOP)} select query_id, doc_id, coalesce(source, doc_id::varchar) as source_key, score, rank::bigint as rank from diverse""",
    "filtered_topk": f"""with {_BM25} select query_id, doc_id, score, rank from (select h.query_id, h.doc_id, h.score, row_number() over (partition by h.query_id order by h.score desc, h.doc_id)::int as rank
        from hits h join documents d using (doc_id) where d.lang = 'en') where rank <= {TOP}""",
    "retrieve_pipeline": f"with {_reranked_sql(max(3 * TOP, CANDIDATES))}, {_diverse_sql('re', TOP)} select query_id, doc_id, score as rerank_score, rank from diverse",
    "handoff_chunks": f"""with {hygiene_sql(f"{_reranked_sql(max(3 * (TOP + EXTRA), CANDIDATES))}, chunks as (select * from re where rank <= {TOP + EXTRA})")},
        cleaned as (select * exclude (rank), row_number() over (partition by query_id order by skipped, adjusted_score desc, rank) as rank from k), {_diverse_sql("cleaned", TOP)}
        select query_id::varchar as sample_id, 'documents' as dataset, rank, doc_id::varchar as chunk_id, score as retrieval_score, source as source_medium, doc_id::varchar as source_doc_id, title from diverse""",
    "hygiene_scores": f"with {hygiene_sql(CHUNKS)} select query_id, chunk_no, flags, penalty, skipped from k",
    "hygiene_rerank": f"with {hygiene_sql(CHUNKS)} select query_id, chunk_no, adjusted_score, row_number() over (partition by query_id order by skipped, adjusted_score desc, rank)::int as hygiene_rank from k",
    "retrieval_recall": f"""with {CHUNKS}, c as (select *, split_part(chunk_id, '::', 1) as doc from chunks),
        g as (select query_id, arg_max(doc, (score, -chunk_no)) as gold from c group by query_id),
        t as (select query_id, list(distinct doc) as docs, avg(score) as score from c where rank <= 5 group by query_id),
        p as (select coalesce(list_contains(docs, gold), false)::int::double as hit, coalesce(len(docs), 0)::double as n, round(score, 9) as score from g left join t using (query_id))
        select count(*) as queries, floor(avg(hit) * 10000 + 0.5)::bigint as recall_at_5, floor(avg(n) * 10000 + 0.5)::bigint as documents_at_5, floor(avg(score) * 10000 + 0.5)::bigint as mean_score from p""",
}
