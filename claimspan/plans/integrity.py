"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import claim_references, null_mask, payload_orphans
from ..runtime import table


def p1_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return payload_orphans(table(spark, folder, "p1_payload"), table(spark, folder, "claim_retractions"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_orphans(spark, folder).select("section", "payload_id", "item_no", "side")


def p1_orphan_detail(spark: SparkSession, folder: str) -> DataFrame:
    return p1_orphans(spark, folder).select("section", "payload_id", "sample_id", "claim_id", "item_no", "side", "reason")


def p1_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per section, month of delivery and reason."""
    return (
        p1_orphans(spark, folder)
        .groupBy("section", F.date_format("delivered_at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count("*").alias("orphans"))
    )


def p1_null_masks(spark: SparkSession, folder: str) -> DataFrame:
    """References by section and null mask (bit 0: sample, bit 1: claim)."""
    return (
        claim_references(table(spark, folder, "p1_payload"))
        .groupBy("section", null_mask(["sample_id", "claim_id"]).alias("null_mask"))
        .agg(F.count("*").alias("refs"))
    )


def p1_orphans_full_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans under MATCH FULL, where a half-null reference is a fault of its own."""
    rows = payload_orphans(table(spark, folder, "p1_payload"), table(spark, folder, "claim_retractions"), "full")
    return rows.groupBy("section", "null_mask", "reason").agg(F.count("*").alias("orphans"))


def p1_orphans_partial_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans under MATCH PARTIAL: a reference without claim id still needs its sample to have a claim then."""
    rows = payload_orphans(table(spark, folder, "p1_payload"), table(spark, folder, "claim_retractions"), "partial")
    return rows.groupBy("section", "null_mask", "reason").agg(F.count("*").alias("orphans"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_orphan_detail, p1_orphan_report, p1_null_masks, p1_orphans_full_match, p1_orphans_partial_match)
}

_REFS = """
refs as (
  select payload_id, sample_id, delivered_at, section, side, i as item_no,
         case side when 'a' then item.claim_a_id else item.claim_b_id end as claim_id
  from (
    select payload_id, sample_id, delivered_at, 'candidate_pairs' as section, unnest(candidate_pairs) as item,
           unnest(range(len(candidate_pairs))) as i from p1_payload
    union all
    select payload_id, sample_id, delivered_at, 'nli_results', struct_pack(claim_a_id := x.claim_a_id, claim_b_id := x.claim_b_id), i
    from (select payload_id, sample_id, delivered_at, unnest(nli_results) as x, unnest(range(len(nli_results))) as i from p1_payload)
  ), (values ('a'), ('b')) s(side)
  where item is not null
),
claims as (
  select sample_id, c.claim_id as claim_id, min(delivered_at) as first_at
  from (select sample_id, delivered_at, unnest(claims) as c from p1_payload) group by all
),
gone as (select sample_id, claim_id, min(retracted_at) as gone_at from claim_retractions group by all),
orphans as (
  select r.*, case when g.gone_at <= r.delivered_at then 'deleted' when c.first_at is null then 'missing' else 'late' end as reason
  from refs r
  left join claims c on c.sample_id = r.sample_id and c.claim_id = r.claim_id
  left join gone g on g.sample_id = r.sample_id and g.claim_id = r.claim_id
  where r.claim_id is not null and (g.gone_at <= r.delivered_at or c.first_at is null or c.first_at > r.delivered_at)
)
"""

ORACLES = {
    "p1_found": f"with {_REFS} select section, payload_id, item_no::int as item_no, side from orphans",
    "p1_orphan_detail": f"with {_REFS} select section, payload_id, sample_id, claim_id, item_no::int as item_no, side, reason from orphans",
    "p1_orphan_report": f"with {_REFS} select section, strftime(delivered_at, '%Y-%m') as month, reason, count(*) as orphans from orphans group by all",
    "p1_null_masks": f"""with {_REFS} select section, ((sample_id is null)::int + 2 * (claim_id is null)::int)::int as null_mask,
        count(*) as refs from refs group by all""",
    "p1_orphans_full_match": f"""with {_REFS} select section, 0 as null_mask, reason, count(*) as orphans from orphans group by all
        union all select section, 2, 'partial', count(*) from refs where claim_id is null group by all""",
    "p1_orphans_partial_match": f"""with {_REFS} select section, 0 as null_mask, reason, count(*) as orphans from orphans group by all
        union all select section, 2, 'partial', count(*) from refs r where claim_id is null and not exists (
          select 1 from claims c left join gone g on g.sample_id = c.sample_id and g.claim_id = c.claim_id
          where c.sample_id = r.sample_id and c.claim_id is not null and c.first_at <= r.delivered_at
            and (g.gone_at is null or g.gone_at > r.delivered_at)) group by all""",
}
