"""References to records that do not exist.

References carry a composite key whose parts may be null. They are grouped by null mask; each mask is
anti-joined with the targets on its non-null columns only, under one of the three match rules of SQL:

* ``simple``: a reference with any null part is not checked.
* ``partial``: the non-null parts must agree with some target; an all-null reference is not checked.
* ``full``: either all parts are null (not checked) or none is; a mixture is an orphan by itself.

Targets may be valid for a time only (``valid_from``, ``valid_until``); a reference made at time ``t`` needs a
target with valid_from <= t and t < valid_until. A null valid_from means always, a null valid_until for ever.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH_RULES = ("simple", "partial", "full")


def null_mask(columns: Sequence[str]) -> Column:
    """Bit i is set where column i is null."""
    return sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0))


def fold_targets(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: the earliest time it is valid from and the earliest time it is withdrawn (aggregated map-side)."""
    return targets.groupBy(*keys).agg(
        F.min("valid_from").alias("valid_from"),
        F.min("valid_until").alias("valid_until"),
        F.max(F.col("exists").cast("int")).cast("boolean").alias("exists"),
    )


def live_points(points: DataFrame, live: DataFrame, keys: Sequence[str], at: str, bucket: str = "day") -> DataFrame:
    """The distinct (keys, at) of ``points`` at which some interval [__target_from, __target_until) of ``live`` with the
    same keys holds.

    An interval holds at t if the largest end among those that began by t lies after t: a running maximum in the order
    of time, so points and intervals never meet in pairs. A key is run through in pieces of one ``bucket`` of time, each
    starting from the maximum of the buckets before it, so that a hot key is spread over many tasks."""
    ever, never = F.lit(datetime(1, 1, 1)), F.lit(datetime(9999, 12, 31))
    asked = points.select(*keys, F.col(at).alias("__t")).distinct().withColumns({"__end": F.lit(None).cast("timestamp"), "__asked": F.lit(True)})
    spans = live.groupBy(*keys, F.coalesce("__target_from", ever).alias("__t")).agg(F.max(F.coalesce("__target_until", never)).alias("__end")).withColumn("__asked", F.lit(False))
    events = asked.unionByName(spans).withColumn("__bucket", F.date_trunc(bucket, "__t"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy(*keys, "__bucket").agg(F.max("__end").alias("__end"))
    carried = ends.select(*keys, "__bucket", F.max("__end").over(earlier).alias("__carried"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = events.withColumn("__end", F.max("__end").over(inside)).where("__asked").join(carried, [*keys, "__bucket"])
    return reached.where(F.greatest("__end", "__carried") > F.col("__t")).select(*keys, F.col("__t").alias(at))


def find_orphans(refs: DataFrame, targets: DataFrame, keys: Sequence[str], at: str | None = None, match: str = "simple") -> DataFrame:
    """Rows of ``refs`` that name no valid target, with ``null_mask`` and ``reason`` added.

    ``targets`` has the same key columns plus optional ``valid_from``, ``valid_until`` (timestamps) and ``exists``
    (false for a row that only withdraws a key, such as a retraction). ``reason`` is missing (no target ever), late
    (the first one comes after ``at``), deleted (withdrawn at or before ``at``), partial (a mixture of nulls under
    ``full``, or, for a reference with nulls under ``partial``, no valid target agrees).

    A key that exists and was withdrawn counts as deleted, one that was only withdrawn as missing before its
    withdrawal and deleted after it; ties (equal times) count as valid from and withdrawn at that moment.
    Repeated reference rows give repeated orphans, repeated targets change nothing, an empty target table makes
    every checked reference missing. Extra columns of ``targets`` are dropped first, so names cannot clash;
    ``refs`` may not have columns called null_mask, reason, or starting with ``__target``.

    The keyed join is one shuffle on the full key. Targets are one row a key by then, so a key that holds a third
    of all references only skews the reference side, which AQE splits.
    """
    if match not in MATCH_RULES:
        raise ValueError(f"match must be one of {MATCH_RULES}, not {match!r}")
    keys = list(keys)
    when = F.col(at) if at else F.lit(None).cast("timestamp")
    have = set(targets.columns)
    targets = targets.select(
        *keys,
        *(F.col(c) if c in have else F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_until")),
        (F.col("exists") if "exists" in have else F.lit(True)).alias("exists"),
    )
    marked = refs.withColumn("null_mask", null_mask(keys))
    whole = (1 << len(keys)) - 1

    known = fold_targets(targets.dropna(subset=keys), keys).select(
        *keys,
        F.col("exists").alias("__target_exists"),
        F.col("valid_from").alias("__target_from"),
        F.col("valid_until").alias("__target_until"),
    )
    deleted = F.col("__target_until").isNotNull() & (when.isNull() | (F.col("__target_until") <= when))
    late = F.col("__target_from").isNotNull() & when.isNotNull() & (F.col("__target_from") > when)
    full_keyed = (
        marked.where(F.col("null_mask") == 0)
        .join(known, keys, "left")
        .withColumn(
            "reason",
            F.when(deleted, "deleted")
            .when(F.col("__target_exists").isNull() | ~F.col("__target_exists"), "missing")
            .when(late, "late"),
        )
        .where(F.col("reason").isNotNull())
        .select(*refs.columns, "null_mask", "reason")
    )
    if match == "simple":
        return full_keyed
    mixed = marked.where((F.col("null_mask") > 0) & (F.col("null_mask") < whole))
    if match == "full":
        return full_keyed.unionByName(mixed.withColumn("reason", F.lit("partial")))
    out = full_keyed
    for nulls in product((False, True), repeat=len(keys)):
        if all(nulls) or not any(nulls):
            continue
        present = [k for k, gone in zip(keys, nulls, strict=True) if not gone]
        mask = sum(1 << i for i, gone in enumerate(nulls) if gone)
        live = known.where("__target_exists").select(*present, "__target_from", "__target_until")
        part = mixed.where(F.col("null_mask") == mask)
        timed = part.where(when.isNotNull())
        unmatched = part.where(when.isNull()).join(live.select(*present).distinct(), present, "left_anti")
        if at:
            points = live_points(timed.select(*present, F.col(at)), live, present, at)
            unmatched = unmatched.unionByName(timed.join(points, [*present, at], "left_anti"))
        out = out.unionByName(unmatched.select(*marked.columns).withColumn("reason", F.lit("partial")))
    return out


def claim_references(payloads: DataFrame) -> DataFrame:
    """One row per claim id named in candidate_pairs and nli_results of each payload, null ids included.

    Null arrays and null elements give no row for the element; positions count from 0 in the array as given.
    """

    def side_of(section: str, side: str) -> Column:
        return F.transform(
            F.coalesce(F.col(section), F.array()),
            lambda pair, i: F.struct(
                F.lit(section).alias("section"),
                i.cast("int").alias("item_no"),
                F.lit(side).alias("side"),
                pair[f"claim_{side}_id"].alias("claim_id"),
                pair.isNotNull().alias("present"),
            ),
        )

    both = F.concat(*(side_of(s, x) for s in ("candidate_pairs", "nli_results") for x in "ab"))
    return (
        payloads.select("payload_id", "sample_id", "delivered_at", F.explode(both).alias("ref"))
        .select("payload_id", "sample_id", "delivered_at", "ref.*")
        .where("present")
        .drop("present")
    )


def claim_targets(payloads: DataFrame, retractions: DataFrame) -> DataFrame:
    """The claims that exist, from their first delivery on, and the retractions that end them."""
    delivered = payloads.select("sample_id", F.col("delivered_at").alias("valid_from"), F.explode("claims").alias("claim")).select(
        "sample_id", F.col("claim.claim_id").alias("claim_id"), "valid_from", F.lit(None).cast("timestamp").alias("valid_until"), F.lit(True).alias("exists")
    )
    withdrawn = retractions.select(
        "sample_id", "claim_id", F.lit(None).cast("timestamp").alias("valid_from"), F.col("retracted_at").alias("valid_until"), F.lit(False).alias("exists")
    )
    return delivered.unionByName(withdrawn)


def payload_orphans(payloads: DataFrame, retractions: DataFrame, match: str = "simple") -> DataFrame:
    return find_orphans(claim_references(payloads), claim_targets(payloads, retractions), ["sample_id", "claim_id"], "delivered_at", match)
