"""Picking the sentences of a body that speak to a headline or claim. One row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..runtime import computed

_QUOTES = "[\"'“”‘’]"


def headline_variants(headline: Column) -> Column:
    """The headline itself, without quotes, its parts around the first colon, and its last six words; distinct, in order."""
    plain = lambda c: F.trim(F.regexp_replace(c, _QUOTES, ""))
    colon = F.instr(headline, ":") > 0
    left = F.trim(F.regexp_extract(headline, "(?s)^([^:]*):", 1))
    right = F.trim(F.regexp_extract(headline, "(?s)^[^:]*:(.*)$", 1))
    words = F.filter(F.split(headline, r"\s+"), lambda w: w != "")
    tail = F.when(F.size(words) > 4, F.array_join(F.slice(words, F.greatest(F.size(words) - 5, F.lit(1)), F.lit(6)), " "))
    made = F.array(plain(headline), F.when(colon, left), F.when(colon, right), F.when(colon, plain(right)), tail)
    return F.array_distinct(F.concat(F.array(F.trim(headline)), F.filter(F.array_compact(made), lambda v: v != "")))


def rank_sentences(rows: DataFrame, headline: str, body: str, out: str = "ranked") -> DataFrame:
    """Adds array<struct<order, position, score, coverage, jaccard>> by score, equal scores in text order.

    Each sentence is held against the headline variant it covers best. Score = .65 coverage + .25 Jaccard, plus .1 for a
    shared number, .08 for a negation on both sides, .05 for quotes on both sides, .06 for a colon headline with two
    shared words, a lead bonus that falls by .02 a sentence from .06, less .08 without a shared word and .04 with one.
    A null or blank body has an empty array."""
    h = F.col(headline)
    tokens = computed(
        rows,
        _variants=F.transform(headline_variants(h), lambda v: T.token_set(v, V.STOPWORDS_HEADLINE)),
        _sentences=F.transform(
            T.sentences_plain(F.col(body)),
            lambda s: F.struct(
                T.token_set(s, V.STOPWORDS_HEADLINE).alias("tokens"), F.regexp_extract_all(s, F.lit(r"\b\d+\b"), F.lit(0)).alias("numbers"), s.rlike(_QUOTES).alias("quoted")
            ),
        ),
        _head=F.struct(
            F.regexp_extract_all(h, F.lit(r"\b\d+\b"), F.lit(0)).alias("numbers"),
            F.arrays_overlap(T.token_set(h, V.STOPWORDS_HEADLINE), T.words_in(V.HEADLINE_NEGATION)).alias("negated"),
            h.rlike(_QUOTES).alias("quoted"),
            (F.instr(h, ":") > 0).alias("colon"),
        ),
    )

    def held_against(v: Column, t: Column) -> Column:
        common = T.size_of_common(v, t)
        either = (F.size(v) == 0) | (F.size(t) == 0)
        return F.struct(
            F.when(either, 0.0).otherwise(common / F.size(v)).alias("coverage"), F.when(either, 0.0).otherwise(common / (F.size(v) + F.size(t) - common)).alias("jaccard"), common.alias("shared")
        )

    best = computed(tokens, _best=F.transform("_sentences", lambda s: F.array_max(F.transform("_variants", lambda v: held_against(v, s["tokens"])))))
    head = F.col("_head")

    def scored(s: Column, position: Column) -> Column:
        b = F.element_at("_best", position + 1)
        score = (
            0.65 * b["coverage"]
            + 0.25 * b["jaccard"]
            + F.when(F.arrays_overlap(head["numbers"], s["numbers"]), 0.1).otherwise(0.0)
            + F.when(head["negated"] & F.arrays_overlap(s["tokens"], T.words_in(V.HEADLINE_NEGATION)), 0.08).otherwise(0.0)
            + F.when(head["quoted"] & s["quoted"], 0.05).otherwise(0.0)
            + F.when(head["colon"] & (b["shared"] >= 2), 0.06).otherwise(0.0)
            + F.greatest(F.lit(0.0), 0.06 - 0.02 * position)
            - F.when(b["shared"] == 0, 0.08).when(b["shared"] == 1, 0.04).otherwise(0.0)
        )
        return F.struct(F.round(-score, 4).alias("order"), position.alias("position"), F.round(score, 4).alias("score"), F.round(b["coverage"], 4).alias("coverage"), F.round(b["jaccard"], 4).alias("jaccard"))

    return best.withColumn(out, F.array_sort(F.transform("_sentences", scored))).drop("_variants", "_sentences", "_head", "_best")


def best_sentence(rows: DataFrame, headline: str, body: str, out: str = "sentence") -> DataFrame:
    """Adds the sentence of the body that ranks first; where its score is below .12 the first sentence, where there is none
    the body."""
    ranked = rank_sentences(rows, headline, body, "_ranked")
    sentences = T.sentences_plain(F.col(body))
    top = F.try_element_at("_ranked", F.lit(1))
    chosen = F.when(top["score"] < 0.12, F.try_element_at(sentences, F.lit(1))).otherwise(F.try_element_at(sentences, top["position"] + 1))
    return ranked.withColumn(out, F.coalesce(chosen, F.trim(F.coalesce(body, F.lit(""))))).drop("_ranked")


def evidence_span(rows: DataFrame, headline: str, body: str, n: int = 2, out: str = "span") -> DataFrame:
    """Adds the first window of n sentences with the largest sum of ranking scores plus .25 coverage and .15 Jaccard of the
    window as a whole; the leading window where that is below .2 or shares no word with the headline. Shorter bodies are
    taken whole."""
    ranked = rank_sentences(rows, headline, body, "_ranked")
    parts = computed(
        ranked,
        _said=T.sentences_plain(F.col(body)),
        _by_place=F.map_from_entries(F.transform("_ranked", lambda r: F.struct(r["position"], r["score"]))),
        _asked=T.token_set(F.col(headline), V.STOPWORDS_HEADLINE),
    )
    window = lambda i: F.array_join(F.slice("_said", i + 1, F.lit(n)), " ")
    starts = F.when(F.size("_said") > n, F.sequence(F.lit(0), F.size("_said") - n)).otherwise(F.array().cast("array<int>"))
    worded = computed(parts, _windows=F.transform(starts, lambda i: F.struct(i.alias("start"), T.token_set(window(i), V.STOPWORDS_HEADLINE).alias("tokens"))))

    def scored(w: Column) -> Column:
        summed = F.aggregate(F.sequence(w["start"], w["start"] + (n - 1)), F.lit(0.0), lambda total, i: total + F.coalesce(F.try_element_at("_by_place", i), F.lit(0.0)))
        asked, tokens = F.col("_asked"), w["tokens"]
        cover = F.when(F.size(tokens) == 0, 0.0).otherwise(T.coverage(asked, tokens))
        return F.struct((summed + 0.25 * cover + 0.15 * T.jaccard(asked, tokens)).alias("score"), (-w["start"]).alias("back"), T.size_of_common(asked, tokens).alias("shared"))

    best = computed(worded, _best=F.array_max(F.transform("_windows", scored)))
    top = F.col("_best")
    start = F.when((top["score"] < 0.2) | (top["shared"] == 0), F.lit(0)).otherwise(-top["back"])
    span = F.when(F.size("_said") == 0, F.trim(F.coalesce(body, F.lit("")))).when(F.size("_said") <= n, F.array_join("_said", " ")).otherwise(window(start))
    return best.withColumn(out, span).drop("_ranked", "_said", "_by_place", "_asked", "_windows", "_best")


def _relevances(rows: DataFrame, claim: str, body: str) -> DataFrame:
    """Adds _tokens (of each sentence) and _each (its lexical relevance to the claim)."""
    tokens = computed(
        rows,
        _query=T.token_set(F.col(claim), V.STOPWORDS_EVIDENCE),
        _tokens=F.transform(T.sentences_plain(F.col(body)), lambda s: T.token_set(s, V.STOPWORDS_EVIDENCE)),
    )
    return computed(tokens, _each=F.transform("_tokens", lambda t: T.lexical_relevance(F.col("_query"), t)))


def best_span(rows: DataFrame, claim: str, body: str, n: int = 2, out: str = "span") -> DataFrame:
    """Adds struct<start, relevance>: the first window of n sentences with the largest summed lexical relevance; shorter
    texts are one window, texts without sentences have null."""
    each = _relevances(rows, claim, body)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_each") - n, F.lit(0)))
    summed = lambda i: F.aggregate(F.slice("_each", i + 1, F.lit(n)), F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(F.transform(starts, lambda i: F.struct(F.round(summed(i), 6).alias("relevance"), (-i).alias("back"))))
    span = F.when(F.size("_each") > 0, F.struct((-top["back"]).alias("start"), top["relevance"].alias("relevance")))
    return each.withColumn(out, span).drop("_query", "_tokens", "_each")


def mmr_select(rows: DataFrame, claim: str, body: str, k: int = 2, lam: float = 0.7, floor: float = 0.05, out: str = "positions") -> DataFrame:
    """Adds the positions of k sentences by maximal marginal relevance, in text order.

    lam * relevance - (1 - lam) * largest Jaccard with a chosen one; the floor on relevance holds from the second pick on;
    ties go to the earlier sentence. A text of k sentences or fewer is taken whole."""
    each = computed(
        _relevances(rows, claim, body),
        _items=F.transform("_tokens", lambda t, i: F.struct(i.alias("position"), t.alias("tokens"), F.element_at("_each", i + 1).alias("relevance"))),
    )
    items = F.col("_items")
    none = F.filter(items, lambda x: F.lit(False))

    def pick(chosen: Column, _: Column) -> Column:
        taken = F.transform(chosen, lambda c: c["position"])
        free = F.filter(items, lambda x: ~F.array_contains(taken, x["position"]) & ((F.size(chosen) == 0) | (x["relevance"] >= floor)))
        penalty = lambda x: F.coalesce(F.array_max(F.transform(chosen, lambda c: T.jaccard(c["tokens"], x["tokens"]))), F.lit(0.0))
        best = F.array_max(F.transform(free, lambda x: F.struct((lam * x["relevance"] - (1 - lam) * penalty(x)).alias("gain"), (-x["position"]).alias("back"), x.alias("item"))))
        return F.concat(chosen, F.when(best.isNotNull(), F.array(best["item"])).otherwise(none))

    picked = F.when(F.size(items) <= k, items).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(k)), none, pick))
    return each.withColumn(out, F.array_sort(F.transform(picked, lambda x: x["position"]))).drop("_query", "_tokens", "_each", "_items")
