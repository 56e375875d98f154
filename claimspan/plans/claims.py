"""Queries over claims, pairs, inference, conflict types and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import claims as C
from ..operators import conflict as K
from ..operators import metrics as M
from ..runtime import computed, spread, table
from . import sql as S
from .typing_sql import ORACLES as TYPED_ORACLES


#: Resamples of the bootstrap.
RESAMPLES = 10_000


def claims_sentence(spark: SparkSession, folder: str) -> DataFrame:
    chunks = C.chunk_inputs(spread(table(spark, folder, "retrieval_json").select("row_id", "query", "retrieved_chunks")), "row_id")
    return C.sentence_claims(chunks, "row_id").select("row_id", "chunk_ord", "sent_no", "role", "text", F.size("entities").alias("n_entities"), "subject", "time", "polarity", "certainty")


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_rows").select("sample_id", F.posexplode("claims").alias("ord", "c"))
    return rows.select("sample_id", "ord", "c.claim_id", "c.text", F.col("c.source_metadata.role").alias("role"), "c.entities")


def block_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return C.candidate_pairs(_claims(spark, folder)).select("sample_id", "ord_a", "ord_b", "entity_overlap", "lexical")


def block_union(spark: SparkSession, folder: str) -> DataFrame:
    return C.candidate_pairs(_claims(spark, folder), mode="union", allow_empty_entities=False).select("sample_id", "ord_a", "ord_b", "entity_overlap", "lexical")


def block_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of block_cascade, found through the token index."""
    return C.candidate_pairs(_claims(spark, folder), indexed=True).select("sample_id", "ord_a", "ord_b", "entity_overlap", "lexical")


def nli_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    labelled = C.label_pairs(C.candidate_pairs(_claims(spark, folder)))
    return labelled.select("sample_id", "ord_a", "ord_b", "label", *(F.col(f"scores.{x}").alias(x) for x in V.NLI_LABELS))


def retention_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs kept per lexical threshold and label."""
    labelled = C.label_pairs(C.candidate_pairs(_claims(spark, folder), least_lexical=0.05))
    levels = F.explode(F.array(*(F.lit(x) for x in (0.05, 0.1, 0.2, 0.3, 0.4)))).alias("threshold")
    return labelled.select("label", "lexical", levels).where("lexical >= threshold").groupBy("threshold", "label").agg(F.count("*").alias("pairs"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_rows").select("sample_id", F.posexplode("cross_source_nli_results").alias("ord", "r"))
    score = F.struct(F.col("r.entailment_score").alias("entailment"), F.col("r.contradiction_score").alias("contradiction"), F.col("r.neutral_score").alias("neutral"))
    return rows.select("sample_id", "ord", F.col("r.label").alias("gold"), score.alias("scores"))


def ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded scores averaged with uniform ones, then sharpened."""
    even = F.struct(*(F.lit(1.0).alias(x) for x in V.NLI_LABELS))
    mixed = C.ensemble(_results(spark, folder).withColumn("even", even), ["scores", "even"], [0.7, 0.3], "mixed")
    sharp = C.with_temperature(mixed, F.lit(0.5), "mixed", "sharp")
    return sharp.select("sample_id", "ord", *(F.floor(F.col(f"sharp.{x}") * 1e4 + 0.5).alias(x) for x in V.NLI_LABELS))


def temperature(spark: SparkSession, folder: str) -> DataFrame:
    return C.fit_temperature(_results(spark, folder)).select("temperature")


def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return C.threshold_grid(_results(spark, folder))


def best_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return C.best_thresholds(threshold_grid(spark, folder))


def error_types(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong predictions by gold and predicted label; a missing one is none."""
    wrong = _scored(spark, folder).where(~F.col("gold").eqNullSafe(F.col("predicted")))
    return wrong.groupBy(F.concat(F.col("gold"), F.lit(" -> "), F.coalesce("predicted", F.lit("none"))).alias("error")).agg(F.count("*").alias("rows"))


def best_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return C.best_pairs(_results(spark, folder)).select("sample_id", "label", "ord", "score")


def claim_fill_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of claims with each slot, per role."""
    rows = table(spark, folder, "benchmark_rows").select(F.explode("claims").alias("c"))
    filled = [F.count(f"c.{n}").alias(f"with_{n}") for n in ("subject", "relation", "object", "qualifier", "time")]
    return rows.groupBy(F.col("c.source_metadata.role").alias("role")).agg(F.count("*").alias("claims"), *filled)


def claim_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Broken, entity-only and title-only claims per sample."""
    rows = table(spark, folder, "benchmark_rows").select("sample_id", F.explode("claims").alias("c"))
    text = F.trim(F.coalesce("c.text", F.lit("")))
    tokens = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    bare = F.col("c.relation").isNull() & F.col("c.object").isNull()
    marked = text.rlike("-(LRB|RRB|LSB|RSB)-")
    broken = bare & (tokens < 8) & ((text.rlike(r"^[^\p{Lu}\p{Lt}\p{Lo}\p{Lm}\p{N}]")) | (~text.rlike(r"[.!?]$") & (text != "")) | marked | (tokens < 4))
    list_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    subject, said = list_of(F.trim(F.coalesce("c.subject", F.lit("")))), list_of(text)
    titled = (F.size(subject) > 0) & (tokens <= 6) & (T.size_of_common(subject, said) >= F.greatest(F.lit(1), F.least(F.size(subject), F.size(said)) - 1))
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("claims"), F.count_if(broken).alias("broken"), F.count_if(bare & (tokens <= 4)).alias("entity_only"), F.count_if(bare & titled).alias("title_only")
    )


def conflict_types(spark: SparkSession, folder: str) -> DataFrame:
    return K.typed_pairs(table(spark, folder, "p1_payload"))


def type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return conflict_types(spark, folder).groupBy("conflict_type", "rule").agg(F.count("*").alias("pairs"))


def fusion(spark: SparkSession, folder: str) -> DataFrame:
    typed = conflict_types(spark, folder)
    return typed.groupBy("nli_label", "direction", "signal").agg(F.count("*").alias("pairs"))


def conflict_summary(spark: SparkSession, folder: str) -> DataFrame:
    return K.conflict_summary(conflict_types(spark, folder))


def source_media(spark: SparkSession, folder: str) -> DataFrame:
    """Claims per normalised medium and host authority."""
    rows = table(spark, folder, "p1_payload").select(F.explode("claims").alias("c")).select("c.source_metadata.*")
    known = computed(rows, medium=K.medium(F.col("source_medium"), F.col("reporting_source")), host=K.host(F.col("source_url")))
    return known.groupBy("medium", K.host_authority(F.col("host")).alias("host_authority")).agg(F.count("*").alias("claims"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_rows")
    return rows.select("sample_id", "dataset", F.coalesce(T.scored_label(F.col("gold_label")), F.lit("neutral")).alias("gold"), T.scored_label(F.col("predicted_label")).alias("predicted"))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion(_scored(spark, folder))


def prf_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return M.per_label(_scored(spark, folder))


def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("dataset").agg(*M.f1_columns("gold", "predicted"))


def evaluate_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded predictions, the keyword heuristic and a constant, each against the gold labels."""
    rows = table(spark, folder, "benchmark_rows").select("sample_id", F.coalesce("query", F.lit("")).alias("query"), "gold_label", "predicted_label")
    gold = rows.select("sample_id", T.scored_label(F.col("gold_label")).alias("gold"))
    one = lambda name, c: rows.select(F.lit(name).alias("baseline"), "sample_id", c.alias("predicted"), F.lit(0).alias("order"))
    predictions = (
        one("recorded", T.scored_label(F.col("predicted_label"))).where(F.col("sample_id").isNotNull())
        .unionByName(one("keywords", T.keyword_label(F.col("query"))))
        .unionByName(one("constant", F.lit("neutral")))
    )
    return M.evaluate(gold, predictions)


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """95 % interval of the macro-F1 of the recorded predictions."""
    samples = M.bootstrap(_scored(spark, folder), RESAMPLES, ["predicted"])
    return M.interval(samples, "f1_predicted")


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_rows")
    label = lambda c: T.scored_label(F.col(c))
    return rows.select(
        "sample_id", F.coalesce(label("gold_label"), F.lit("neutral")).alias("gold"), label("predicted_label").alias("recorded"), T.keyword_label(F.coalesce("query", F.lit(""))).alias("keywords"), F.lit("neutral").alias("constant")
    )


def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded predictions against the keyword heuristic: mean difference and share of resamples where it is not above 0."""
    delta = M.bootstrap(_compared(spark, folder), RESAMPLES, ["recorded", "keywords"]).withColumn("delta", F.col("f1_recorded") - F.col("f1_keywords"))
    return delta.agg(F.round(F.avg("delta"), 4).alias("mean_delta"), (F.count_if(F.col("delta") <= 0) / F.count("*")).alias("p_value"))


def mode_significance(spark: SparkSession, folder: str) -> DataFrame:
    """Every way of predicting against the constant one."""
    return M.significance(_compared(spark, folder), "constant", ["recorded", "keywords"], iterations=RESAMPLES)


def score_averages(spark: SparkSession, folder: str) -> DataFrame:
    return M.averages(_scored(spark, folder))


def missing_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows that have no recorded label."""
    rows = table(spark, folder, "benchmark_rows")
    predictions = rows.where("predicted_label is not null").select(F.lit("recorded").alias("baseline"), "sample_id")
    return M.unaligned(rows.select("sample_id"), predictions)


def coverage_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Share of rows with a cross-source pair and with a decisive result, per dataset and over all (rollup)."""
    rows = table(spark, folder, "benchmark_rows")
    decisive = F.exists(F.coalesce("cross_source_nli_results", F.array().cast(rows.schema["cross_source_nli_results"].dataType)), lambda r: r["label"] != "neutral")
    return rows.rollup("dataset").agg(
        F.count("*").alias("rows"), F.count_if(F.col("cross_source_pair_count") > 0).alias("with_pair"), F.count_if(F.coalesce(decisive, F.lit(False))).alias("decisive"), F.sum("claim_count").alias("claims")
    )


QUERIES = {
    f.__name__: f
    for f in (
        claims_sentence, block_cascade, block_union, nli_heuristic, retention_sweep, ensemble, temperature, threshold_grid, best_thresholds, error_types, best_pairs, claim_fill_rates, claim_shapes, conflict_types,
        type_counts, fusion, conflict_summary, source_media, confusion, prf_by_label, macro_f1, evaluate_baselines, bootstrap_ci, paired_bootstrap, mode_significance, score_averages, missing_predictions, block_indexed, coverage_by_dataset,
    )
}

_CLAIMS = f"""c as (select sample_id, i as ord, c.claim_id as claim_id, c.text as text, c.source_metadata.role as role, coalesce(c.entities, []) as ents, {S.token_set("c.text")} as tk
  from (select sample_id, unnest(claims) as c, unnest(range(len(claims)))::int as i from benchmark_rows))"""
_PAIRS = f"""{_CLAIMS}, p as (select a.sample_id as sample_id, a.ord as ord_a, b.ord as ord_b, a.text as text_a, b.text as text_b, len(a.ents) as na, len(b.ents) as nb,
  len(list_intersect(list_distinct(a.ents), list_distinct(b.ents)))::int as entity_overlap, {S.jaccard("a.tk", "b.tk")} as lexical from c a join c b on a.sample_id = b.sample_id and a.ord < b.ord)"""
_CASCADE = "(na = 0 or nb = 0 or entity_overlap >= 1)"


def _nli_sql(floor: float) -> str:
    has = lambda w, hints: f"list_has_any({w}, {S.strings(hints)})"
    supported = " or ".join(f"(list_contains({p}, '{x}') and list_contains({q}, '{y}'))" for x, y in V.SUPPORTED_NEGATION for p, q in (("wa", "wb"), ("wb", "wa")))
    rules = f"""case when lexical >= 0.18 and ({supported}) then 1 when lexical >= 0.22 and {has("wa", V.REFUTATION_HINTS)} <> {has("wb", V.REFUTATION_HINTS)} then 2
      when lexical >= 0.3 and {has("wa", V.NEGATION_HINTS)} <> {has("wb", V.NEGATION_HINTS)} then 3 when lexical >= 0.4 then 4 else 5 end"""
    return rf"""{_PAIRS}, w as (select *, regexp_split_to_array(lower(coalesce(text_a, '')), '\s+') as wa, regexp_split_to_array(lower(coalesce(text_b, '')), '\s+') as wb from p where lexical >= {floor} and {_CASCADE}),
n as (select *, {rules} as rule from w)"""


_RESULTS = """r as (select sample_id, i as ord, r.label as gold, r.entailment_score as e, r.contradiction_score as c, r.neutral_score as n
  from (select sample_id, unnest(cross_source_nli_results) as r, unnest(range(len(cross_source_nli_results)))::int as i from benchmark_rows))"""
_SCORED = f"s as (select sample_id, dataset, coalesce({S.scored_label('gold_label')}, 'neutral') as gold, {S.scored_label('predicted_label')} as predicted from benchmark_rows)"


def _macro(gold: str = "gold", pred: str = "predicted") -> str:
    def f1(x: str) -> str:
        tp, fp, fn = (f"count(*) filter (where {t})" for t in (f"{gold} = '{x}' and {pred} = '{x}'", f"{gold} <> '{x}' and {pred} = '{x}'", f"{gold} = '{x}' and {pred} is distinct from '{x}'"))
        return f"(case when 2 * {tp} + {fp} + {fn} > 0 then 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) else 0.0 end)"

    return f"round(({f1('entailment')} + {f1('contradiction')} + {f1('neutral')}) / 3, 6)::double"


def _f1_sql(x: str, gold: str = "gold", pred: str = "predicted") -> str:
    tp, fp, fn = (f"count(*) filter (where {t})" for t in (f"{gold} = '{x}' and {pred} = '{x}'", f"{gold} <> '{x}' and {pred} = '{x}'", f"{gold} = '{x}' and {pred} is distinct from '{x}'"))
    return f"round(case when 2 * {tp} + {fp} + {fn} > 0 then 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) else 0.0 end, 6)::double"


_LABEL = "case when e >= c and e >= n then 'entailment' when c >= n then 'contradiction' else 'neutral' end"

ORACLES = {
    "block_cascade": f"with {_PAIRS} select sample_id, ord_a, ord_b, entity_overlap, lexical from p where lexical >= 0.1 and {_CASCADE}",
    # Lexical similarity and (entities or embedding), where the embedding stage passes as no threshold is set.
    "block_union": f"with {_PAIRS} select sample_id, ord_a, ord_b, entity_overlap, lexical from p where lexical >= 0.1",
    "block_indexed": f"with {_PAIRS} select sample_id, ord_a, ord_b, entity_overlap, lexical from p where lexical >= 0.1 and {_CASCADE}",
    "nli_heuristic": f"""with {_nli_sql(0.1)} select sample_id, ord_a, ord_b, ['entailment', 'contradiction', 'contradiction', 'entailment', 'neutral'][rule] as label,
        [0.76, 0.08, 0.08, 0.82, 0.1][rule]::double as entailment, [0.12, 0.78, 0.82, 0.08, 0.1][rule]::double as contradiction, [0.12, 0.14, 0.1, 0.1, 0.8][rule]::double as neutral from n""",
    "retention_sweep": f"""with {_nli_sql(0.05)} select threshold::double as threshold, ['entailment', 'contradiction', 'contradiction', 'entailment', 'neutral'][rule] as label, count(*) as pairs
        from n, (select unnest([0.05, 0.1, 0.2, 0.3, 0.4]) as threshold) where lexical >= threshold group by all""",
    "ensemble": f"""with {_RESULTS}, a as (select *, greatest(e, 0) + greatest(c, 0) + greatest(n, 0) as t from r),
        b as (select sample_id, ord, 0.7 * (case when t > 0 then greatest(e, 0) / t else 1 / 3.0 end) + 0.1 as e, 0.7 * (case when t > 0 then greatest(c, 0) / t else 1 / 3.0 end) + 0.1 as c,
          0.7 * (case when t > 0 then greatest(n, 0) / t else 1 / 3.0 end) + 0.1 as n from a),
        d as (select *, e * e + c * c + n * n as t from b)
        select sample_id, ord, floor(round(e * e / t, 6) * 10000 + 0.5)::bigint as entailment, floor(round(c * c / t, 6) * 10000 + 0.5)::bigint as contradiction, floor(round(n * n / t, 6) * 10000 + 0.5)::bigint as neutral from d""",
    "threshold_grid": f"""with {_RESULTS}, g as (select *, {_LABEL} as top from r), x as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as t),
        q as (select a.t as t_ent, b.t as t_con, gold, case when top = 'entailment' and e >= a.t then top when top = 'contradiction' and c >= b.t then top else 'neutral' end as predicted from g, x a, x b)
        select t_ent::double as t_ent, t_con::double as t_con, {_macro()} as macro_f1 from q group by t_ent, t_con""",
    "error_types": f"with {_SCORED} select gold || ' -> ' || coalesce(predicted, 'none') as error, count(*) as rows from s where gold is distinct from predicted group by all",
    "best_pairs": f"""with {_RESULTS}, u as (select sample_id, ord, 'entailment' as label, e as score from r union all select sample_id, ord, 'contradiction', c from r union all select sample_id, ord, 'neutral', n from r)
        select sample_id, label, ord, score from (select *, row_number() over (partition by sample_id, label order by score desc, ord) as k from u) where k = 1""",
    "claim_fill_rates": """select c.source_metadata.role as role, count(*) as claims, count(c.subject) as with_subject, count(c.relation) as with_relation, count(c.object) as with_object,
        count(c.qualifier) as with_qualifier, count(c.time) as with_time from (select unnest(claims) as c from benchmark_rows) group by all""",
    "confusion": f"with {_SCORED} select gold, predicted, count(*) as n from s group by all",
    "macro_f1": f"with {_SCORED} select dataset, {_macro()} as macro_f1 from s group by dataset",
    "prf_by_label": f"""with {_SCORED}, l as (select distinct unnest([gold, predicted]) as label from s),
        k as (select label, count(*) filter (where gold = label and predicted is not distinct from label) as tp, count(*) filter (where gold is distinct from label and predicted = label) as fp,
          count(*) filter (where gold = label and predicted is distinct from label) as fn from s, l where label is not null group by label)
        select label, case when tp + fp > 0 then round(tp::double / (tp + fp), 6) else 0.0 end as precision, case when tp + fn > 0 then round(tp::double / (tp + fn), 6) else 0.0 end as recall,
          round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6)::double as f1, tp + fn as support from k""",
    "temperature": f"""with {_RESULTS}, t as (select unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0]) as temperature),
        a as (select *, greatest(e, 0) + greatest(c, 0) + greatest(n, 0) as s from r), b as (select gold, case when s > 0 then greatest(e, 0) / s else 1 / 3.0 end as e, case when s > 0 then greatest(c, 0) / s else 1 / 3.0 end as c,
          case when s > 0 then greatest(n, 0) / s else 1 / 3.0 end as n from a),
        p as (select temperature::double as temperature, gold, pow(greatest(e, 1e-12), 1 / temperature) as e, pow(greatest(c, 1e-12), 1 / temperature) as c, pow(greatest(n, 1e-12), 1 / temperature) as n from b, t),
        l as (select temperature, round(sum(-ln(greatest(round((case gold when 'entailment' then e when 'contradiction' then c else n end) / (e + c + n), 6), 1e-12))), 6) as loss from p group by temperature)
        select temperature from l order by loss, temperature limit 1""",
    "claim_shapes": rf"""with c as (select sample_id, trim(coalesce(c.text, '')) as t, c.relation is null and c.object is null as bare, regexp_extract_all(lower(trim(coalesce(c.subject, ''))), '[a-z0-9]+') as su,
          regexp_extract_all(lower(trim(coalesce(c.text, ''))), '[a-z0-9]+') as sa from (select sample_id, unnest(claims) as c from benchmark_rows)),
        k as (select *, len(regexp_extract_all(t, '[A-Za-z0-9]+')) as n from c)
        select sample_id, count(*) as claims, count(*) filter (where bare and n < 8 and (regexp_matches(t, '^[^\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{Lm}}\p{{N}}]') or (not regexp_matches(t, '[.!?]$') and t <> '') or regexp_matches(t, '-(LRB|RRB|LSB|RSB)-') or n < 4)) as broken,
          count(*) filter (where bare and n <= 4) as entity_only, count(*) filter (where bare and len(su) > 0 and n <= 6 and len(list_intersect(list_distinct(su), list_distinct(sa))) >= greatest(1, least(len(su), len(sa)) - 1)) as title_only from k group by sample_id""",
    "fusion": f"""with {S.SIGNALS}, ro as (select payload_id, c.claim_id as claim_id, arg_max_null(lower(trim(c.source_metadata.role)), i) as role from (select payload_id, unnest(claims) as c, unnest(range(len(claims))) as i from p1_payload) where c.claim_id is not null group by all),
        d as (select s.*, coalesce(list_contains({S.strings(V.CLAIM_ROLES)}, ra.role), false) as ac, coalesce(list_contains({S.strings(V.CLAIM_ROLES)}, rb.role), false) as bc, coalesce(list_contains({S.strings(V.EVIDENCE_ROLES)}, ra.role), false) as ae,
          coalesce(list_contains({S.strings(V.EVIDENCE_ROLES)}, rb.role), false) as be from sig s left join ro ra on ra.payload_id = s.payload_id and ra.claim_id = s.a left join ro rb on rb.payload_id = s.payload_id and rb.claim_id = s.b)
        select nli_label, case when ac and not bc then 'a_as_claim' when bc and not ac then 'b_as_claim' when ae and not be then 'b_as_claim' when be and not ae then 'a_as_claim' else 'bidirectional' end as direction, signal,
          count(*) as pairs from d group by all""",
    "score_averages": f"""with {_SCORED}, l as (select distinct unnest([gold, predicted]) as label from s),
        k as (select label, count(*) filter (where gold = label and predicted is not distinct from label) as tp, count(*) filter (where gold is distinct from label and predicted = label) as fp,
          count(*) filter (where gold = label and predicted is distinct from label) as fn from s, l where label is not null group by label),
        m as (select label, case when tp + fp > 0 then round(tp::double / (tp + fp), 6) else 0.0 end as p, case when tp + fn > 0 then round(tp::double / (tp + fn), 6) else 0.0 end as r,
          round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6)::double as f, tp + fn as n from k)
        select round((select avg((gold is not distinct from predicted)::int) from s), 4)::double as accuracy, round(avg(p), 4) as macro_precision, round(avg(r), 4) as macro_recall, round(avg(f), 4) as macro_f1,
          round(sum(f * n) / sum(n), 4)::double as weighted_f1, (select count(*) from s) as support from m""",
    "missing_predictions": "select distinct 'recorded' as baseline, sample_id from benchmark_rows where sample_id not in (select sample_id from benchmark_rows where predicted_label is not null)",
    "evaluate_baselines": f"""with b as (select sample_id, coalesce({S.scored_label('gold_label')}, 'neutral') as gold, coalesce(query, '') as query, {S.scored_label('predicted_label')} as recorded from benchmark_rows),
        w as (select *, regexp_extract_all(lower(query), '[a-z'']+') as ws from b),
        q as (select 'recorded' as baseline, gold, recorded as predicted from w union all select 'constant', gold, 'neutral' from w union all
          select 'keywords', gold, case when list_has_any(ws, {S.strings(V.KEYWORDS_REFUTE)}) then 'contradiction' when list_has_any(ws, {S.strings(V.KEYWORDS_SUPPORT)}) then 'entailment' else 'neutral' end from w)
        select baseline, (select count(*) from b) as support, count(*) as aligned, {_f1_sql("contradiction")} as contradiction_f1, {_macro()} as macro_f1,
          round(count(*) filter (where predicted is null)::double / count(*), 6) as abstention_rate, 0.0::double as missing_rate from q group by baseline""",
    "coverage_by_dataset": """select dataset, count(*) as rows, count(*) filter (where cross_source_pair_count > 0) as with_pair,
        count(*) filter (where len(list_filter(coalesce(cross_source_nli_results, []), lambda r: r.label <> 'neutral')) > 0) as decisive, sum(claim_count)::bigint as claims from benchmark_rows group by rollup (dataset)""",
}
ORACLES["best_thresholds"] = f"select * from ({ORACLES['threshold_grid']}) order by macro_f1 desc, t_ent, t_con limit 1"
ORACLES |= {k: v for k, v in TYPED_ORACLES.items() if k in QUERIES}
