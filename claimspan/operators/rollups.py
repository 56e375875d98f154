"""One row a sample from its pairs, labels and types: benchmark records, answer plans, and checks of types against verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V

#: Conflict types that go with a verdict.
VERDICT_TYPES = {
    "Supported": ("none", "temporal_conflict"),
    "Refuted": ("hard_contradiction", "misinformation"),
    "Conflicting Evidence/Cherrypicking": ("ambiguity", "opinion_conflict", "hard_contradiction"),
}
SIGNALS = ("agreement", "conflict", "neutral", "unrelated", "inconclusive")


def crosses_sources(role_a: Column, role_b: Column) -> Column:
    """Whether one side is the query and the other retrieved evidence."""
    return F.coalesce(F.array_sort(F.array(role_a, role_b)) == F.array(F.lit("query"), F.lit("retrieved_evidence")), F.lit(False))


def benchmark_records(results: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, cross_pairs, predicted_label, best_<label>_score, best_<label>_a, best_<label>_b) of samples with results.

    ``results``: (sample, ord, claim_a_id, claim_b_id, cross, scores). Only pairs across sources count; the first pair with
    the largest score is the best of its label, and the first label, in the order of labels within the first such pair, is
    predicted. Samples without such pairs have no prediction and scores 0."""
    cross = lambda x: F.when(F.col("cross"), x)
    ids = F.struct("claim_a_id", "claim_b_id")
    rank = lambda label: cross(F.struct(F.col(f"scores.{label}").alias("score"), (-F.col("ord")).alias("back")))
    best = [F.max_by(cross(ids), rank(x)).alias(x) for x in V.NLI_LABELS]
    tops = [F.max(rank(x)).alias(f"top_{x}") for x in V.NLI_LABELS]
    sums = results.groupBy(sample).agg(F.count_if("cross").alias("cross_pairs"), *best, *tops)
    each = (F.when(F.col(f"top_{x}").isNotNull(), F.struct(f"top_{x}.score", f"top_{x}.back", F.lit(-i).alias("label_back"), F.lit(x).alias("label"))) for i, x in enumerate(V.NLI_LABELS))
    overall = F.array_max(F.array_compact(F.array(*each)))
    named = sums.select("*", overall.alias("overall"), *(F.coalesce(F.col(f"top_{x}.score"), F.lit(0.0)).alias(f"best_{x}_score") for x in V.NLI_LABELS))
    pairs = [F.col(f"{x}.claim_{side}_id").alias(f"best_{x}_{side}") for x in V.NLI_LABELS for side in "ab"]
    return named.select(sample, "cross_pairs", F.col("overall.label").alias("predicted_label"), *(f"best_{x}_score" for x in V.NLI_LABELS), *pairs)


def service_labels(samples: DataFrame, results: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, predicted_label, three scores): the largest of each score over all pairs, whatever their roles, and the label
    of the largest; samples without pairs are neutral with scores 0, 0, 1."""
    tops = results.groupBy(sample).agg(*(F.max(f"scores.{x}").alias(x) for x in V.NLI_LABELS))
    joined = samples.select(sample).distinct().join(tops, sample, "left")
    filled = joined.select(sample, *(F.coalesce(x, F.lit(1.0 if x == "neutral" else 0.0)).alias(x) for x in V.NLI_LABELS))
    e, c, n = (F.col(x) for x in V.NLI_LABELS)
    return filled.withColumn("predicted_label", F.when((e >= c) & (e >= n), "entailment").when(c >= n, "contradiction").otherwise("neutral"))


def signal_counts(typed: DataFrame, key: str = "payload_id") -> DataFrame:
    """(key, pairs, one column a signal), all five signals always there."""
    return typed.groupBy(key).agg(F.count("*").alias("pairs"), *(F.count_if(F.col("signal") == s).alias(s) for s in SIGNALS))


def type_maps(typed: DataFrame, key: str = "payload_id") -> DataFrame:
    """(key, types): how often each conflict type occurs, as a map."""
    counts = typed.groupBy(key, "conflict_type").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("conflict_type", "n")))).alias("types"))


def answer_plans(payloads: DataFrame, typed: DataFrame, key: str = "payload_id") -> DataFrame:
    """(key, query_text, first_type, first_policy, evidence, citations) of each payload.

    The query is the text of the first claim with the role query, else of the first claim, else empty. Type and policy are
    those of the first pair. Evidence is the first five texts of retrieved evidence, or, where there is none, the addresses
    of all claims; citations are the claim ids of all pairs, sorted."""
    claims = F.filter(F.coalesce("claims", F.array().cast(payloads.schema["claims"].dataType)), lambda c: c.isNotNull())
    asked = F.filter("c", lambda c: c["source_metadata"]["role"] == "query")
    filled = lambda texts: F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    texts = filled(F.transform(F.filter("c", lambda c: c["source_metadata"]["role"] == "retrieved_evidence"), lambda c: c["text"]))
    urls = F.array_distinct(filled(F.transform("c", lambda c: c["source_metadata"]["source_url"])))
    rows = payloads.select(key, claims.alias("c")).select(
        key, F.coalesce(F.try_element_at(asked, F.lit(1))["text"], F.try_element_at("c", F.lit(1))["text"], F.lit("")).alias("query_text"),
        F.when(F.size(texts) > 0, F.slice(texts, 1, 5)).otherwise(urls).alias("evidence"),
    )
    firsts = typed.groupBy(key).agg(
        F.min_by("conflict_type", "pair_no").alias("first_type"), F.min_by("policy", "pair_no").alias("first_policy"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("claim_a_id", "claim_b_id")))))).alias("citations"),
    )
    return rows.join(firsts, key, "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def type_sets(samples: DataFrame, typed: DataFrame, key: str) -> DataFrame:
    """``samples`` with ``types``, the set of their conflict types, and whether every pair fell to the last rule."""
    sets = typed.groupBy(key).agg(F.collect_set("conflict_type").alias("types"), F.bool_and(F.col("rule") == "signal").alias("all_last"))
    return samples.join(sets, key, "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def aligned(verdict: Column, types: Column) -> Column:
    """Whether the conflict types found go with the verdict: any of the verdict's own; for too little evidence none but
    noise; null for other verdicts."""
    out = F.when(verdict == "Not Enough Evidence", F.size(F.array_except(types, F.array(F.lit("noise")))) == 0)
    for name, wanted in VERDICT_TYPES.items():
        out = out.when(verdict == name, F.arrays_overlap(types, F.array(*(F.lit(t) for t in wanted))))
    return out


def suspicion(verdict: Column, types: Column, all_last: Column) -> Column:
    """The first reason to look at a sample again; null without one."""
    has = lambda *names: F.arrays_overlap(types, F.array(*(F.lit(n) for n in names)))
    return (
        F.when(F.size(types) == 0, "no pairs")
        .when((verdict == "Supported") & has("hard_contradiction", "misinformation"), "supported but conflicting")
        .when((verdict == "Refuted") & (types == F.array(F.lit("none"))), "refuted but without conflict")
        .when((verdict == "Conflicting Evidence/Cherrypicking") & ~has("ambiguity", "opinion_conflict", "hard_contradiction", "temporal_conflict"), "conflicting but no conflict found")
        .when((types == F.array(F.lit("hard_contradiction"))) & all_last, "no rule but the last")
    )


def deltas(rows: DataFrame, by: str, one: str, other: str, values: list[str]) -> DataFrame:
    """(value, one, other, delta) of the configurations ``one`` and ``other`` in column ``by``, which has one row each."""
    spread = rows.where(F.col(by).isin(one, other)).select(by, F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values))).alias("s")).select(by, "s.*")
    wide = spread.groupBy("value").agg(F.max(F.when(F.col(by) == one, F.col("x"))).alias(one), F.max(F.when(F.col(by) == other, F.col("x"))).alias(other))
    return wide.select("value", one, other, F.round(F.col(other) - F.col(one), 4).alias("delta"))
