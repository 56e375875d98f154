"""Reports on queries, evidence and answers: buckets, failure labels, clusters, fired rules, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .conflict import RULES

# Wording that puts a query into a bucket, and the buckets in order.
QUOTE_PHRASES = ("according to", "claimed", "announced", "reported", "attributed", "mistakenly attributed")
TIME_WORDS = ("born", "died", "released", "premiered", "started", "ended", "founded")
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DESCRIPTORS = (" is a person", " is an actor", " is a broadcaster", " is a character", " is a city", " is a country", " is a film", " is a musician")
ENTITY_PHRASES = ("real name", "is a ", "is an ", "was a ", "was an ", "is the ", "was the ", "character on", "known as", "called ")
BUCKETS = ("very_short_factoid", "yes_no_claim_like", "entity_seeking", "temporal_query", "ambiguous_name_query", "quoted_or_attribution_heavy")


def _holds(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def query_bucket(query: Column) -> Column:
    """The first bucket whose wording fits; null queries are very short."""
    q = F.coalesce(query, F.lit(""))
    low = F.lower(F.trim(q))
    tokens = F.size(F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    capitals = F.size(F.regexp_extract_all(q, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Za-z0-9'_-]*"), F.lit(0)))
    return (
        F.when(q.rlike('["“”]') | _holds(low, QUOTE_PHRASES), "quoted_or_attribution_heavy")
        .when(q.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])({MONTHS})(?![\p{{L}}\p{{N}}_])") | q.rlike(r"(?<![\p{L}\p{N}_])(1[5-9]\d{2}|20\d{2})(?![\p{L}\p{N}_])") | _holds(low, TIME_WORDS), "temporal_query")
        .when((tokens <= 6) & (capitals >= 2) & _holds(low, DESCRIPTORS), "ambiguous_name_query")
        .when(_holds(low, ENTITY_PHRASES), "entity_seeking")
        .when(tokens <= 5, "very_short_factoid")
        .otherwise("yes_no_claim_like")
    )


def failure_label(pairs: Column, short_claim: Column, collapsed: Column, noisy: Column, bucket: Column, tokens: Column) -> Column:
    """Why a record has no decisive result: the first reason that holds."""
    return (
        F.when(pairs == 0, "NO_CROSS_SOURCE_SIGNAL")
        .when(short_claim & bucket.isin("very_short_factoid", "ambiguous_name_query", "entity_seeking"), "Q_SHORT")
        .when(collapsed, "Q_COLLAPSED_IN_P1")
        .when(noisy, "EVIDENCE_STILL_NOISY")
        .when(bucket.isin("ambiguous_name_query", "entity_seeking") | (tokens <= 7), "Q_UNDERSPECIFIED")
        .otherwise("EVIDENCE_OK_BUT_NOT_COMPARABLE")
    )


def fired_rules(typed: DataFrame) -> DataFrame:
    """Every rule with how often it fired and a tag: DEAD (never), DOMINANT (more than half of all), or none."""
    rules = typed.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    counts = typed.groupBy("rule").agg(F.count("*").alias("fired"))
    total = counts.agg(F.coalesce(F.sum("fired"), F.lit(0)).alias("total"))
    joined = rules.join(F.broadcast(counts), "rule", "left").join(F.broadcast(total)).na.fill(0, ["fired"])
    return joined.select("rule", "fired", F.when(F.col("fired") == 0, "DEAD").when(2 * F.col("fired") > F.col("total"), "DOMINANT").alias("tag"))


def evidence_clusters(typed: DataFrame, key: str = "payload_id") -> DataFrame:
    """(key, claim_id, cluster): each claim's cluster by its first pair: support, oppose or neutral."""
    cluster = F.when(F.col("signal") == "agreement", "support").when(F.col("signal") == "conflict", "oppose").otherwise("neutral")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("claim_a_id").alias("claim_id")), F.struct(F.lit(1).alias("side"), F.col("claim_b_id").alias("claim_id")))).alias("s")
    rows = typed.select(key, "pair_no", cluster.alias("cluster"), sides).select(key, F.col("s.claim_id").alias("claim_id"), F.struct("pair_no", F.col("s.side")).alias("seen"), "cluster")
    return rows.where("claim_id is not null").groupBy(key, "claim_id").agg(F.min_by("cluster", "seen").alias("cluster"))


def exclusive_percentile(rows: DataFrame, group: str, value: str, tenth: int = 9) -> DataFrame:
    """(group, mean, decile): the tenth-th decile by the exclusive method, (n + 1) * tenth / 10 with interpolation.

    Distinct values are counted map-side. Their counts are summed in at most 2,000 buckets of a group by sign and size, and
    only the buckets that hold the two places wanted are ranked, so no group is ranked as a whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    size = F.floor(F.log2(F.abs(F.col(value).cast("double")) + 1) * 16)
    bucketed = counts.withColumn("bucket", F.when(F.col(value) < 0, -size).otherwise(size))
    sums = bucketed.groupBy(group, "bucket").agg(F.sum("n").alias("held"), F.sum(F.col(value) * F.col("n")).alias("sum"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    placed = sums.select(group, "bucket", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(whole).alias("total"), F.sum("sum").over(whole).alias("sum"))
    first = F.least(F.greatest(F.floor((F.col("total") + 1) * tenth / 10), F.lit(1)), F.greatest(F.col("total") - 1, F.lit(1)))
    wanted = placed.withColumn("first", first).withColumn("second", F.least(F.col("first") + 1, F.col("total")))
    holds = lambda place, start, n: (place > start) & (place <= start + n)
    kept = wanted.where(holds(F.col("first"), F.col("start"), F.col("held")) | holds(F.col("second"), F.col("start"), F.col("held")))
    same = F.col(f"b.{group}").eqNullSafe(F.col(f"k.{group}")) & (F.col("b.bucket") == F.col("k.bucket"))
    met = bucketed.alias("b").join(kept.alias("k"), same).select(f"b.{group}", "b.bucket", f"b.{value}", "n", "start", "total", "sum", "first", "second")
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(group, "bucket").orderBy(value))
    ranked = met.withColumn("upto", upto)
    at = lambda place: F.max(F.when(holds(F.col(place), F.col("upto") - F.col("n"), F.col("n")), F.col(value)))
    part = (F.max("total") + 1) * tenth / 10 - F.max("first")
    return ranked.groupBy(group).agg(F.round(F.max("sum") / F.max("total"), 4).alias("mean"), F.round(at("first") + (at("second") - at("first")) * part, 4).alias("decile"))


def relevant(query: Column, text: Column) -> Column:
    """Whether a text shares a keyword with the query; a query without keywords lets everything pass."""
    asked = T.relevance_keywords(query)
    return (F.size(asked) == 0) | F.arrays_overlap(asked, T.relevance_keywords(text))
