"""Queries over structured claims, the stance baseline and the incremental pipeline's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import structured as X
from ..runtime import cut, table
from ..streaming.claims_stream import labelled_pairs
from . import sql as S


def claims_structured(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "averitec").select("record_id", F.col("claim").alias("text"))
    return X.structured_slots(rows).select("record_id", "subject", "relation", "object", "qualifier", "full")


def claim_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The relation that each claim states."""
    found = X.found_relation(F.col("claim"))
    return table(spark, folder, "averitec").select("record_id", found["relation"].alias("relation"))


def top_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The 12 most frequent relations, ties by name."""
    counts = claim_relations(spark, folder).where("relation is not null").groupBy("relation").agg(F.count("*").alias("claims"))
    return counts.orderBy(F.desc("claims"), "relation").limit(12)


def structured_fill_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Claims per relation, with how many of them have all slots; every relation, most frequent first by count."""
    return claims_structured(spark, folder).groupBy("relation").agg(F.count("*").alias("claims"), F.count_if("full").alias("full"))


def stance_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on the train split, scored on the others: rows per split, label and prediction."""
    rows = X.stance_rows(table(spark, folder, "averitec").select("record_id", "split", "claim", "label"), "claim", "label")
    model = X.stance_pipeline().fit(cut(rows.where("split = 'train'")))
    scored = model.transform(rows.where("split <> 'train'"))
    return scored.groupBy("split", "label_text", F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("rows"))


def claim_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Claims, blocking and inference over all retrieval records in one plan."""
    return labelled_pairs(table(spark, folder, "retrieval_json"))


QUERIES = {f.__name__: f for f in (claims_structured, claim_relations, top_relations, structured_fill_rates, stance_baseline, claim_pipeline)}
_Q = r"""(?:\'[^\']{2,}\'|"[^"]{2,}"|“[^”]{2,}”|‘[^’]{2,}’)""".replace("\\'", "''")
# Every word with its place and whether a quotation holds it; a quotation starts and ends next to no letter.
ORACLES: dict[str, str] = {
    "claim_relations": f"""with p as (select record_id, unnest(parts) as part, unnest(range(len(parts))) as i from (
          select record_id, regexp_extract_all(lower(coalesce(claim, '')), '(?:it[''’]s|isn[''’]t|aren[''’]t|wasn[''’]t|weren[''’]t|hasn[''’]t|haven[''’]t|not dead)|{_Q}|[\\p{{L}}\\p{{N}}_]+') as parts from averitec)),
        w as (select record_id, i, 0 as j, part as word, false as quoted from p where not regexp_full_match(part, '{_Q}') union all
          select record_id, i, unnest(range(len(ws))), unnest(ws), true from (select record_id, i, regexp_extract_all(part, '[\\p{{L}}\\p{{N}}_]+') as ws from p where regexp_full_match(part, '{_Q}'))),
        h as (select record_id, i, j, quoted, case when word in ('it''s', 'it’s', 'isn''t', 'isn’t', 'not dead') then 'is' when word in ('aren''t', 'aren’t') then 'are' when word in ('wasn''t', 'wasn’t') then 'was'
            when word in ('weren''t', 'weren’t') then 'were' when word in ('hasn''t', 'hasn’t') then 'has' when word in ('haven''t', 'haven’t') then 'have' when list_contains({S.strings(V.RELATION_HINTS)}, word) then word end as relation, word from w),
        f as (select *, row_number() over (partition by record_id, word order by i, j) as nth from h where relation is not null),
        c as (select record_id, relation, row_number() over (partition by record_id order by quoted, i, j) as k from f where nth = 1)
        select a.record_id as record_id, relation from averitec a left join c on c.record_id = a.record_id and k = 1""",
}
ORACLES["top_relations"] = f"select relation, count(*) as claims from ({ORACLES['claim_relations']}) where relation is not null group by relation order by claims desc, relation limit 12"
