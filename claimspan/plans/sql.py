"""Pieces of SQL shared by the oracles of several plans."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import vocab as V


def strings(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def ascii_words(text: str) -> str:
    runs = rf"regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}_]+')"
    return f"list_transform(list_filter({runs}, lambda w: regexp_full_match(w, '[a-zA-Z0-9]+')), lambda w: lower(w))"


def token_set(text: str, stopwords: Iterable[str] = V.STOPWORDS_BLOCKING) -> str:
    return f"list_distinct(list_filter({ascii_words(text)}, lambda w: not list_contains({strings(stopwords)}, w)))"


def token_list(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def sentences_plain(text: str) -> str:
    marked = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '\n+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else {common}::double / (len({a}) + len({b}) - {common}) end)"


def coverage(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / len({a}) end)"


def letter_words(text: str) -> str:
    runs = rf"regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}_]+')"
    return f"list_transform(list_filter({runs}, lambda w: regexp_full_match(w, '[a-zA-Z]+')), lambda w: lower(w))"


def has(words: str, values: Iterable[str]) -> str:
    return f"list_has_any({words}, {strings(values)})"


def polarity(text: str) -> str:
    w = letter_words(text)
    return f"(case when {has(w, V.NEGATIVE_HINTS)} then 'negative' when {has(w, V.UNCERTAIN_HINTS)} then 'uncertain' else 'positive' end)"


def scored_label(raw: str) -> str:
    low = f"lower(trim({raw}))"
    cases = " ".join(f"when list_contains({strings(names)}, {low}) then {'null' if label is None else repr(label)}" for label, names in V.LABEL_ALIASES.items())
    return f"(case {cases} else {low} end)"


#: sig: the pairs of p1_payload with their label and the signal that it makes.
SIGNALS = """pid as (select distinct payload_id, claim.claim_id as claim_id from (select payload_id, unnest(claims) as claim from p1_payload) where claim.claim_id is not null),
res as (select payload_id, r.claim_a_id as a, r.claim_b_id as b, arg_max_null(r.label, i) as nli_label from (select payload_id, unnest(nli_results) as r, unnest(range(len(nli_results))) as i from p1_payload) group by all),
prs as (select payload_id, i::int as pair_no, p.claim_a_id as a, p.claim_b_id as b from (select payload_id, unnest(candidate_pairs) as p, unnest(range(len(candidate_pairs))) as i from p1_payload)),
sig as (select p.*, nli_label, case when ca.claim_id is null or cb.claim_id is null then 'inconclusive' when nli_label = 'entailment' then 'agreement' when nli_label = 'contradiction' then 'conflict'
    when nli_label = 'neutral' then 'neutral' else 'inconclusive' end as signal
  from prs p left join res on res.payload_id = p.payload_id and res.a = p.a and res.b = p.b left join pid ca on ca.payload_id = p.payload_id and ca.claim_id = p.a
  left join pid cb on cb.payload_id = p.payload_id and cb.claim_id = p.b)"""
