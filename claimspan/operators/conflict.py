"""Fusing stance with inference, and telling in what way two claims differ. One expression a result column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..runtime import computed


def role_direction(role_a: Column, role_b: Column) -> Column:
    """Which side is the claim: a_as_claim, b_as_claim or bidirectional."""
    claim = lambda r: F.coalesce(r.isin(*V.CLAIM_ROLES), F.lit(False))
    evidence = lambda r: F.coalesce(r.isin(*V.EVIDENCE_ROLES), F.lit(False))
    a, b = F.lower(F.trim(role_a)), F.lower(F.trim(role_b))
    return (
        F.when(claim(a) & ~claim(b), "a_as_claim")
        .when(claim(b) & ~claim(a), "b_as_claim")
        .when(evidence(a) & ~evidence(b), "b_as_claim")
        .when(evidence(b) & ~evidence(a), "a_as_claim")
        .otherwise("bidirectional")
    )


def lexical_stance(claim: Column, evidence: Column) -> Column:
    """struct<stance, score> without a model: evidence (its first three sentences) that covers less than a tenth of the
    claim's words is filtered, other evidence supports or opposes as the heuristic inference says."""
    from .claims import heuristic_scores, top_label

    seen = T.first_sentences(evidence, 3)
    asked, said = T.token_set(claim), T.token_set(seen)
    scores = heuristic_scores(claim, seen, T.jaccard(asked, said))
    label = top_label(scores)
    near = T.coverage(asked, said)
    stance = F.when(near < 0.1, "filtered").when(label == "entailment", "support").when(label == "contradiction", "oppose").otherwise("neutral")
    score = F.when(near < 0.1, 1 - near).otherwise(F.greatest(scores["entailment"], scores["contradiction"], scores["neutral"]))
    return F.when(claim.isNotNull() & evidence.isNotNull(), F.struct(stance.alias("stance"), score.alias("score")))


def fuse(stance: Column, score: Column, nli: Column) -> Column:
    """struct<signal, confidence>. A score of 0 counts as not given, as everywhere in this scheme."""
    s = F.when(stance == "support", "agreement").when(stance == "oppose", "conflict").when(stance == "neutral", "neutral").when(stance == "filtered", "unrelated").otherwise("")
    n = F.when(nli == "entailment", "agreement").when(nli == "contradiction", "conflict").when(nli == "neutral", "neutral").otherwise("")
    given = F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(0.5))
    out = lambda signal, confidence: F.struct(signal.alias("signal"), confidence.cast("double").alias("confidence"))
    return (
        F.when(s == "unrelated", out(F.lit("unrelated"), F.coalesce(score, F.lit(0.0))))
        .when((s == "") & (n == ""), out(F.lit("inconclusive"), F.lit(0.0)))
        .when(s == "", out(n, F.lit(0.6)))
        .when(n == "", out(s, given))
        .when(s == n, out(s, F.least(F.lit(1.0), 0.5 + 0.5 * given)))
        .otherwise(out(F.lit("inconclusive"), 0.3 * given))
    )


def _any(text: Column, values: list[str], test) -> Column:
    return reduce(lambda a, b: a | b, (test(text, v) for v in values))


def medium(source_medium: Column, reporting_source: Column) -> Column:
    """The medium in one spelling; without one, what the reporting source suggests."""
    given = F.regexp_replace(F.replace(F.replace(F.lower(F.trim(source_medium)), F.lit("-"), F.lit("_")), F.lit("/"), F.lit("_")), r"\s+", "_")
    aliases = F.create_map(*(F.lit(x) for pair in V.MEDIUM_ALIASES.items() for x in pair))
    (first, pattern), *others = V.REPORTING_SOURCES
    guess = F.when(F.lower(reporting_source).rlike(pattern), first)
    for name, pattern in others:
        guess = guess.when(F.lower(reporting_source).rlike(pattern), name)
    return F.coalesce(F.try_element_at(aliases, given), F.when(given != "", given), guess, F.lit(""))


def host(url: Column) -> Column:
    """Host of the address, of the archived page where the address is one of an archive; lower case, without www."""
    inner = F.try_url_decode(F.replace(F.regexp_extract(url, r"(?i)/web/\d+/(https?://\S+)", 1), F.lit("+"), F.lit("%2B")))
    real = F.coalesce(F.nullif(inner, F.lit("")), url)
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(real, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def host_authority(name: Column) -> Column:
    within = lambda h, suffix: (h == suffix) | h.endswith("." + suffix)
    return (
        F.when(name == "", F.lit(None).cast("double"))
        .when(name.endswith(".gov") | name.endswith(".edu"), 0.9)
        .when(_any(name, V.HIGH_DOMAINS, within), 0.86)
        .when(_any(name, V.LOW_DOMAINS, within), 0.18)
    )


def authority(explicit: Column, kind: Column, domain_score: Column, role: Column) -> Column:
    """A given value; none for opinion; the mean of medium and host; either; else the prior of the role."""
    tiers = F.create_map(*(F.lit(x) for pair in V.MEDIUM_AUTHORITY.items() for x in pair))
    roles = F.create_map(*(F.lit(x) for pair in V.ROLE_AUTHORITY.items() for x in pair))
    tier = F.try_element_at(tiers, kind)
    return (
        F.when(explicit.isNotNull(), explicit)
        .when(kind.isin(*V.OPINION_MEDIA), F.lit(None).cast("double"))
        .when(tier.isNotNull() & domain_score.isNotNull(), 0.5 * tier + 0.5 * domain_score)
        .otherwise(F.coalesce(domain_score, tier, F.try_element_at(roles, F.lower(F.trim(role)))))
    )


def year_month(*sources: Column) -> Column:
    """First yyyy-mm found in the sources: ISO-like, Chinese or month name with year, in this order within a source."""

    def of(s: Column) -> Column:
        pair = lambda p, y, m: F.when(s.rlike(p), F.concat(F.regexp_extract(s, p, y), F.lit("-"), F.lpad(m(F.regexp_extract(s, p, 3 - y)), 2, "0")))
        number = F.create_map(*(F.lit(x) for i, name in enumerate(V.MONTHS) for x in (name, str(i + 1))))
        return F.coalesce(pair(V.ISO_MONTH, 1, lambda m: m), pair(V.CHINESE_MONTH, 1, lambda m: m), pair(V.NAMED_MONTH, 2, lambda m: F.try_element_at(number, F.substring(F.lower(m), 1, 3))))

    return F.coalesce(*(of(s) for s in sources))


def year(*sources: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(s, V.YEAR, 0), F.lit("")) for s in sources))


def largest_number(text: Column) -> Column:
    """The largest number in the text that is no year; null without one."""
    found = F.regexp_extract_all(text, F.lit(V.NUMBER), F.lit(0))
    values = F.transform(found, lambda n: F.regexp_replace(n, ",", "").cast("double"))
    return F.array_max(F.filter(values, lambda v: ~((v == F.floor(v)) & v.between(1900, 2099))))


def person(text: Column) -> Column:
    """Words of the first full name, lower case."""
    name = F.regexp_extract(text, V.FULL_NAME, 1)
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"[^A-Za-z\s]", " ")), r"\s+"), lambda w: w != "")


def claim_features(claims: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``features``: all that pair rules need of one claim, once a claim. Needs the columns text, subject, time, role,
    source_url, source_medium, reporting_source, claim_date, question, authority."""
    t = F.col(text)
    opening = computed(computed(claims, _host=host(F.col("source_url"))), _medium=medium(F.col("source_medium"), F.col("reporting_source")), _domain=host_authority(F.col("_host")))
    kind = F.col("_medium")
    opinion_kind = (
        kind.isin(*V.OPINION_MEDIA)
        | kind.rlike("opinion|editorial|commentary|column|op_ed")
        | F.coalesce(F.lower("source_url").rlike("/(opinion|op-ed|editorial|commentary|columns?)/"), F.lit(False))
        | F.coalesce(F.col("question").rlike("(?i)opinion|editorial|commentary"), F.lit(False))
    )
    features = F.struct(
        authority(F.col("authority"), kind, F.col("_domain"), F.col("role")).alias("authority"),
        F.col("_domain").alias("domain_score"),
        opinion_kind.alias("opinion_medium"),
        F.coalesce(t.rlike("(?i)" + V.OPINION_PATTERN), F.lit(False)).alias("opinion_text"),
        F.coalesce(t.rlike("(?i)" + V.NEGATION_PATTERN), F.lit(False)).alias("negated"),
        F.coalesce(t.rlike("(?i)" + V.REFUTATION_PATTERN), F.lit(False)).alias("refuting"),
        year_month(F.col("time"), F.col("claim_date"), t).alias("year_month"),
        year(F.col("time"), F.col("claim_date"), t).alias("year"),
        largest_number(t).alias("number"),
        person(t).alias("person"),
        F.nullif(F.lower(F.trim("subject")), F.lit("")).alias("subject"),
        T.content_tokens(t).alias("content"),
    )
    return computed(opening, features=features).drop("_host", "_medium", "_domain")


#: Of each rule: conflict type (None: what the signal says), largest confidence, and what it adds to the signal's own.
RULES = {
    "missing": ("ambiguity", 0.1, None), "unrelated": ("noise", 0.8, None), "calm": ("none", 0.8, None), "time": ("temporal_conflict", 0.9, 0.2), "number": ("ambiguity", 0.8, 0.15),
    "subject": ("ambiguity", 0.85, 0.2), "opinion_medium": ("opinion_conflict", 0.75, 0.1), "source_gap": ("ambiguity", 0.7, 0.15), "authority_gap": ("misinformation", 0.8, 0.15),
    "opinion_text": ("opinion_conflict", 0.7, 0.1), "signal": (None, 1.0, 0.0),
}


def type_conflicts(pairs: DataFrame) -> DataFrame:
    """Adds rule, conflict_type, confidence and policy to pairs with features_a, features_b (null: claim missing),
    nli_label and signal.

    First match wins: missing, unrelated, agreement or neutral without override, then time, number, subject, opinion
    medium, authority gap, opinion wording, and what the signal alone says."""
    a, b, nli, signal = F.col("features_a"), F.col("features_b"), F.col("nli_label"), F.col("signal")
    sure = lambda c: F.coalesce(c, F.lit(False))
    one = computed(pairs, _same=T.size_of_common(a["content"], b["content"]), _gap=F.abs(a["authority"] - b["authority"]), _larger=F.greatest(F.abs(a["number"]), F.abs(b["number"])))
    same, gap, larger = F.col("_same"), F.col("_gap"), F.col("_larger")
    ends = lambda k: F.try_element_at(a["person"], F.lit(k)) == F.try_element_at(b["person"], F.lit(k))
    names = (F.size(a["person"]) >= 2) & (F.size(b["person"]) >= 2) & (a["person"] != b["person"]) & ends(1) & ends(-1)
    two = computed(
        one,
        _lexical=sure(~sure(nli == "entailment") & (same > 0) & (((a["refuting"] | b["refuting"]) & (same >= 2)) | ((a["negated"] != b["negated"]) & (same >= 4)))),
        _source=sure(nli.isNull() & (gap >= 0.55) & (a["authority"] <= 0.25) & (b["authority"] >= 0.7) & ~b["negated"] & ~b["refuting"] & (b["domain_score"] >= 0.8)),
        _times=sure(a["year_month"] != b["year_month"]) | sure(a["year"] != b["year"]),
        _numbers=sure((larger > 0) & (F.abs(a["number"] - b["number"]) >= 0.1 * larger)),
        _subjects=F.when(a["subject"].isNotNull() & b["subject"].isNotNull(), a["subject"] != b["subject"]).otherwise(sure(names)),
        _wide=sure(gap >= 0.35),
    )
    lexical, source, calm = F.col("_lexical"), F.col("_source"), signal.isin("agreement", "neutral")
    rule = (
        F.when(a.isNull() | b.isNull(), "missing")
        .when(signal == "unrelated", "unrelated")
        .when(calm & ~lexical & ~source, "calm")
        .when(F.col("_times"), "time")
        .when(F.col("_numbers"), "number")
        .when(F.col("_subjects"), "subject")
        .when(a["opinion_medium"] | b["opinion_medium"], "opinion_medium")
        .when(F.col("_wide") & calm & source & ~lexical, "source_gap")
        .when(F.col("_wide"), "authority_gap")
        .when(a["opinion_text"] | b["opinion_text"], "opinion_text")
        .otherwise("signal")
    )
    three = computed(
        two,
        rule=rule,
        _base=F.when(signal == "conflict", 0.6).when(signal == "inconclusive", 0.5).when(lexical, 0.45).otherwise(0.5),
        _kind=F.when((signal == "conflict") | ((signal == "agreement") & lexical), "hard_contradiction").otherwise("ambiguity"),
    )
    of_rule = lambda k, default: F.element_at(F.create_map(*(F.lit(x) for name, row in RULES.items() for x in (name, default if row[k] is None else row[k]))), F.col("rule"))
    fixed = F.col("rule").isin(*(n for n, row in RULES.items() if row[2] is None))
    four = computed(
        three,
        conflict_type=F.when(F.col("rule") == "signal", F.col("_kind")).otherwise(of_rule(0, "")),
        confidence=F.round(F.when(fixed, of_rule(1, 0.0)).otherwise(F.least(of_rule(1, 0.0), F.col("_base") + of_rule(2, 0.0))), 4),
    )
    policies = F.create_map(*(F.lit(x) for pair in V.CONFLICT_POLICIES.items() for x in pair))
    return four.withColumn("policy", F.element_at(policies, F.col("conflict_type"))).drop("_same", "_gap", "_larger", "_lexical", "_source", "_times", "_numbers", "_subjects", "_wide", "_base", "_kind")


def typed_pairs(payloads: DataFrame, key: str = "payload_id", stance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row per candidate pair of each payload with NLI label, signal and conflict type.

    ``stance`` gives struct<stance, score> from the texts of the claim and the evidence side (see lexical_stance; a model can
    be put in as a pandas UDF); without it only the NLI label makes the signal. A pair with a side missing has no stance and
    is inconclusive.

    Claims, pairs and results are joined by (payload, id); of repeated claim ids or results the last in the array counts.
    Null ids and ids without claim leave a side missing."""
    claims = payloads.select(key, F.posexplode("claims").alias("ord", "c")).where("c.claim_id is not null")
    newest = claims.groupBy(key, F.col("c.claim_id").alias("claim_id")).agg(F.max_by("c", "ord").alias("c"))
    flat = newest.select(
        key, "claim_id", "c.text", "c.subject", "c.time",
        *(F.col(f"c.source_metadata.{n}").alias(n) for n in ("role", "source_url", "source_medium", "reporting_source", "claim_date", "question", "authority")),
    )
    known = claim_features(flat).select(key, "claim_id", "role", "text", "features")
    results = payloads.select(key, F.posexplode("nli_results").alias("ord", "r")).select(key, "ord", "r.*").groupBy(key, "claim_a_id", "claim_b_id").agg(F.max_by("label", "ord").alias("nli_label"))
    pairs = payloads.select(key, F.posexplode("candidate_pairs").alias("pair_no", "p")).select(key, "pair_no", "p.claim_a_id", "p.claim_b_id")
    side = lambda x: known.select(key, F.col("claim_id").alias(f"claim_{x}_id"), F.col("role").alias(f"role_{x}"), F.col("text").alias(f"text_{x}"), F.col("features").alias(f"features_{x}"))
    joined = pairs.join(results, [key, "claim_a_id", "claim_b_id"], "left").join(side("a"), [key, "claim_a_id"], "left").join(side("b"), [key, "claim_b_id"], "left")
    direction = role_direction(F.col("role_a"), F.col("role_b"))
    if stance is None:
        held = joined.withColumn("_stance", F.lit(None).cast("struct<stance: string, score: double>"))
    else:
        swapped = direction == "b_as_claim"
        sides = computed(joined, _claim=F.when(swapped, F.col("text_b")).otherwise(F.col("text_a")), _evidence=F.when(swapped, F.col("text_a")).otherwise(F.col("text_b")))
        held = computed(sides, _stance=F.when(F.col("features_a").isNotNull() & F.col("features_b").isNotNull(), stance(F.col("_claim"), F.col("_evidence"))))
    whole = F.col("features_a").isNotNull() & F.col("features_b").isNotNull()
    nothing = F.struct(F.lit("inconclusive").alias("signal"), F.lit(0.0).alias("confidence"))
    fused = computed(held, fused=F.when(whole, fuse(F.col("_stance.stance"), F.col("_stance.score"), F.col("nli_label"))).otherwise(nothing))
    typed = type_conflicts(fused.withColumn("signal", F.col("fused.signal")))
    return typed.select(
        key, "pair_no", "claim_a_id", "claim_b_id", "nli_label", F.col("_stance.stance").alias("stance"), direction.alias("direction"), "signal",
        F.col("fused.confidence").alias("fusion_confidence"), "conflict_type", "confidence", "policy", "rule",
    )


def conflict_summary(typed: DataFrame, key: str = "payload_id") -> DataFrame:
    """Per payload: pairs, share of hard contradictions, share of low confidence (< .45), mean confidence, the most
    frequent policy (ties: the one seen first), and whether to abstain."""
    counted = typed.groupBy(key, "policy").agg(F.count("*").alias("n"), F.min("pair_no").alias("first_seen"))
    most = counted.groupBy(key).agg(F.max_by("policy", F.struct("n", -F.col("first_seen"))).alias("primary_policy"))
    sums = typed.groupBy(key).agg(
        F.count("*").alias("pairs"),
        F.round(F.avg((F.col("conflict_type") == "hard_contradiction").cast("int")), 6).alias("contradiction_ratio"),
        F.round(F.avg((F.col("confidence") < 0.45).cast("int")), 6).alias("low_confidence_ratio"),
        F.round(F.sum((F.col("confidence") * 10_000).cast("bigint")) / F.count("*") / 10_000, 6).alias("mean_confidence"),
    )
    abstain = (F.col("primary_policy") == "abstain") | (F.col("contradiction_ratio") >= 0.5) | ((F.col("low_confidence_ratio") >= 0.6) & (F.col("mean_confidence") <= 0.5))
    strategies = F.create_map(*(F.lit(x) for pair in V.POLICY_STRATEGIES.items() for x in pair))
    joined = sums.join(most, key).withColumn("abstain", abstain)
    return joined.withColumn("strategy", F.when(F.col("abstain"), "abstain_with_explanation").otherwise(F.element_at(strategies, F.col("primary_policy"))))
