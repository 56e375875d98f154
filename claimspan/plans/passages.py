"""Queries over chunks and evidence sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import chunking as C
from ..operators import evidence as E
from ..runtime import spread, table
from . import sql as S


def chunks_v1(spark: SparkSession, folder: str) -> DataFrame:
    return C.window_chunks(spread(table(spark, folder, "documents").select("doc_id", "text")))


def chunks_v2(spark: SparkSession, folder: str) -> DataFrame:
    return C.sentence_chunks(spread(table(spark, folder, "documents").select("doc_id", "text")), least_tokens=12)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "retrieval_json").select("row_id", "query", "retrieved_chunks")).select("row_id", "query", F.posexplode("retrieved_chunks.text").alias("chunk_no", "text"))
    return rows.select("row_id", "chunk_no", "query", F.coalesce("text", F.lit("")).alias("text"))


def rank_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The three best sentences of each retrieved chunk for its query."""
    ranked = E.rank_sentences(_pairs(spark, folder), "query", "text")
    return ranked.select("row_id", "chunk_no", F.posexplode(F.slice("ranked", 1, 3)).alias("rank", "s")).select("row_id", "chunk_no", "rank", "s.position", "s.score")


def best_span(spark: SparkSession, folder: str) -> DataFrame:
    spans = E.best_span(_pairs(spark, folder), "query", "text")
    return spans.select("row_id", "chunk_no", "span.start", F.floor(F.col("span.relevance") * 1e4 + 0.5).alias("relevance"))


def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    return E.mmr_select(_pairs(spark, folder), "query", "text").select("row_id", "chunk_no", "positions")


QUERIES = {f.__name__: f for f in (chunks_v1, chunks_v2, rank_sentences, best_span, mmr_select)}

_Q, _T = S.token_set("query", V.STOPWORDS_EVIDENCE), S.token_set("s", V.STOPWORDS_EVIDENCE)
ORACLES = {
    "chunks_v1": r"""with t as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as tk from documents),
        w as (select doc_id, tk, unnest(range(case when len(tk) <= 160 then 1 else ceil((len(tk) - 160) / 130.0)::bigint + 1 end))::int as chunk_no from t where len(tk) > 0)
        select doc_id, chunk_no, len(tk[chunk_no * 130 + 1:chunk_no * 130 + 160])::int as n_tokens, array_to_string(tk[chunk_no * 130 + 1:chunk_no * 130 + 160], ' ') as chunk from w""",
    "best_span": f"""with p as (select row_id, query, coalesce(c.text, '') as text, i::int as chunk_no from (
          select row_id, query, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json)),
        u as (select row_id, chunk_no, query, unnest({S.sentences_plain("text")}) as s, unnest(range(len({S.sentences_plain("text")}))) as pos from p),
        r as (select row_id, chunk_no, pos, 0.6 * {S.coverage(_Q, _T)} + 0.4 * {S.jaccard(_Q, _T)} as rel from u),
        w as (select row_id, chunk_no, pos, count(*) over (partition by row_id, chunk_no) as n, rel + coalesce(lead(rel) over (partition by row_id, chunk_no order by pos), 0) as two from r),
        x as (select *, row_number() over (partition by row_id, chunk_no order by round(two, 6) desc, pos) as k from w where pos <= greatest(n - 2, 0))
        select p.row_id, p.chunk_no, x.pos::int as start, floor(round(x.two, 6) * 10000 + 0.5)::bigint as relevance from p left join x on x.row_id = p.row_id and x.chunk_no = p.chunk_no and k = 1""",
}

_CHUNKS = """p as (select row_id, query, coalesce(c.text, '') as text, i::int as chunk_no from (select row_id, query, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json))"""
_PLAIN = lambda c: f"trim(regexp_replace({c}, '[\"''“”‘’]', '', 'g'))"
_LEFT, _RIGHT = "trim(regexp_extract(query, '(?s)^([^:]*):', 1))", "trim(regexp_extract(query, '(?s)^[^:]*:(.*)$', 1))"
_WORDS = r"list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '')"
_NUMBERS = lambda c: rf"list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[0-9]+'))"
_HEAD = S.token_set("query", V.STOPWORDS_HEADLINE)
#: ranked (row_id, chunk_no, pos, s, score, rank): sentences of the chunks in order for their query.
RANKED = rf"""{_CHUNKS}, v0 as (select row_id, chunk_no, unnest(list_distinct(list_concat([trim(query)], list_filter([{_PLAIN("query")}, case when contains(query, ':') then {_LEFT} end, case when contains(query, ':') then {_RIGHT} end,
    case when contains(query, ':') then {_PLAIN(_RIGHT)} end, case when len({_WORDS}) > 4 then array_to_string({_WORDS}[-6:], ' ') end], lambda x: x is not null and x <> '')))) as v from p),
va as (select row_id, chunk_no, {S.token_set("v", V.STOPWORDS_HEADLINE)} as vt from v0),
u as (select row_id, chunk_no, query, unnest({S.sentences_plain("text")}) as s, unnest(range(len({S.sentences_plain("text")}))) as pos from p),
ut as (select *, {S.token_set("s", V.STOPWORDS_HEADLINE)} as st from u),
best as (select * from (select ut.*, len(list_intersect(vt, st)) as shared, case when len(st) = 0 then 0.0 else {S.coverage("vt", "st")} end as cov, {S.jaccard("vt", "st")} as jac,
    row_number() over (partition by row_id, chunk_no, pos order by case when len(st) = 0 then 0.0 else {S.coverage("vt", "st")} end desc, {S.jaccard("vt", "st")} desc, len(list_intersect(vt, st)) desc) as k from ut join va using (row_id, chunk_no)) where k = 1),
points as (select *, 0.65 * cov + 0.25 * jac + (case when list_has_any({_NUMBERS("query")}, {_NUMBERS("s")}) then 0.1 else 0.0 end)
    + (case when list_has_any({_HEAD}, {S.strings(V.HEADLINE_NEGATION)}) and list_has_any(st, {S.strings(V.HEADLINE_NEGATION)}) then 0.08 else 0.0 end)
    + (case when regexp_matches(query, '["''“”‘’]') and regexp_matches(s, '["''“”‘’]') then 0.05 else 0.0 end) + (case when contains(query, ':') and shared >= 2 then 0.06 else 0.0 end)
    + greatest(0.0::double, 0.06::double - 0.02::double * pos) - (case when shared = 0 then 0.08 when shared = 1 then 0.04 else 0.0 end) as raw from best),
ranked as (select row_id, chunk_no, pos, s, st, round(raw::varchar::decimal(38, 18), 4)::double as score, row_number() over (partition by row_id, chunk_no order by round((-raw)::varchar::decimal(38, 18), 4), pos) - 1 as rank from points)"""
_RELEVANT = f"""{_CHUNKS}, u as (select row_id, chunk_no, query, unnest({S.sentences_plain("text")}) as s, unnest(range(len({S.sentences_plain("text")}))) as pos from p),
r as (select *, count(*) over (partition by row_id, chunk_no) as n, {_T} as tk, 0.6 * {S.coverage(_Q, _T)} + 0.4 * {S.jaccard(_Q, _T)} as rel from u)"""
ORACLES |= {
    "rank_sentences": f"with {RANKED} select row_id, chunk_no, rank::int as rank, pos::int as position, score from ranked where rank < 3",
    "mmr_select": f"""with {_RELEVANT}, one as (select * from (select *, row_number() over (partition by row_id, chunk_no order by 0.7 * rel - (1 - 0.7) * 0.0 desc, pos) as k from r) where k = 1),
        two as (select * from (select r.*, row_number() over (partition by r.row_id, r.chunk_no order by 0.7 * r.rel - (1 - 0.7) * {S.jaccard("one.tk", "r.tk")} desc, r.pos) as k
          from r join one on one.row_id = r.row_id and one.chunk_no = r.chunk_no and one.pos <> r.pos where r.rel >= 0.05) where k = 1),
        c as (select row_id, chunk_no, pos from r where n <= 2 union all select row_id, chunk_no, pos from one where n > 2 union all select row_id, chunk_no, pos from two where n > 2),
        g as (select row_id, chunk_no, list(pos::int order by pos) as positions from c group by all)
        select p.row_id, p.chunk_no, coalesce(positions, []::int[]) as positions from p left join g on g.row_id = p.row_id and g.chunk_no = p.chunk_no""",
}
