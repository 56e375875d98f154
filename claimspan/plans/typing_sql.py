"""SQL of conflict typing over p1_payload: the same decision table as the operator, stated once more in another language."""

from __future__ import annotations

from ..functions import vocab as V
from .sql import SIGNALS, strings

_EDGE = r"[^\p{L}\p{N}_]"


def _whole(pattern: str) -> str:
    """The pattern between places that are no word characters, in one group."""
    return rf"(?:^|{_EDGE})(?:{pattern})(?:$|{_EDGE})"


def _first(column: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def _year_month(column: str) -> str:
    iso = _whole(r"((?:19|20)\d{2})[-/](0?[1-9]|1[0-2])(?:[-/](?:0?[1-9]|[12]\d|3[01]))?")
    chinese = r"((?:19|20)\d{2})年\s*(0?[1-9]|1[0-2])月"
    named = "(?i)" + _whole(r"(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december)\.?\s+((?:19|20)\d{2})")
    month = f"(list_position({strings(V.MONTHS)}, left(lower({_first(column, named, 1)}), 3)))::varchar"
    parts = [f"{_first(column, p, 1)} || '-' || lpad({_first(column, p, 2)}, 2, '0')" for p in (iso, chinese)]
    return f"coalesce({parts[0]}, {parts[1]}, {_first(column, named, 2)} || '-' || lpad({month}, 2, '0'))"


def _case(column: str, table: dict, otherwise: str = "null") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(case {column} " + " ".join(f"when '{k}' then {show(v)}" for k, v in table.items()) + f" else {otherwise} end)"


def _within(names: list[str]) -> str:
    return f"len(list_filter({strings(names)}, lambda s: host = s or ends_with(host, '.' || s))) > 0"


_GUESS = "case " + " ".join(f"when regexp_matches(lower(reporting_source), '{p}') then '{n}'" for n, p in V.REPORTING_SOURCES) + " end"
_GIVEN = r"regexp_replace(replace(replace(lower(trim(source_medium)), '-', '_'), '/', '_'), '\s+', '_', 'g')"
_INNER = r"nullif(url_decode(replace(regexp_extract(source_url, '(?i)/web/\d+/(https?://\S+)', 1), '+', '%2B')), '')"
_CUT = ", ".join(f"case when ends_with(w, '{end}') and length(w) > {longer} then left(w, length(w) - {len(end)}) end" for end, longer in (("e", 4), ("ed", 5), ("ing", 6), ("es", 5), ("s", 4)))
_WORDING = lambda pattern: "coalesce(regexp_matches(text, '(?i)" + pattern.replace("'", "''") + "'), false)"
_PERSON = _whole(r"([A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)+)")

_SOURCE = ", ".join(f"c.source_metadata.{n} as {n}" for n in ("role", "source_url", "source_medium", "reporting_source", "claim_date", "question", "authority"))

_NEWEST = "newest as (select payload_id, c.claim_id as claim_id, arg_max_null(c, i) as c from (select payload_id, unnest(claims) as c, unnest(range(len(claims))) as i from p1_payload) where c.claim_id is not null group by all)"
_HOSTED = rf"""flat as (select payload_id, claim_id, c.text as text, c.subject as subject, c.time as time, {_SOURCE} from newest),
medium as (select *, coalesce({_case('given', V.MEDIUM_ALIASES)}, nullif(given, ''), guess, '') as kind,
  regexp_replace(lower(coalesce(regexp_extract(coalesce(inner_url, source_url), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')), '^www\.', '') as host
  from (select *, {_GIVEN} as given, {_GUESS} as guess, {_INNER} as inner_url from flat)),
hosted as (select *, case when host = '' then null when ends_with(host, '.gov') or ends_with(host, '.edu') then 0.9 when {_within(V.HIGH_DOMAINS)} then 0.86 when {_within(V.LOW_DOMAINS)} then 0.18 end::double as dom,
  {_case('kind', V.MEDIUM_AUTHORITY)}::double as tier from medium)"""
FEATURES = rf"""{_NEWEST}, {_HOSTED},
feat as (select payload_id, claim_id, lower(trim(role)) as role, dom,
  case when authority is not null then authority when list_contains({strings(V.OPINION_MEDIA)}, kind) then null when tier is not null and dom is not null then 0.5 * tier + 0.5 * dom
    else coalesce(dom, tier, {_case('lower(trim(role))', V.ROLE_AUTHORITY)}) end::double as auth,
  list_contains({strings(V.OPINION_MEDIA)}, kind) or regexp_matches(kind, 'opinion|editorial|commentary|column|op_ed') or coalesce(regexp_matches(lower(source_url), '/(opinion|op-ed|editorial|commentary|columns?)/'), false)
    or coalesce(regexp_matches(question, '(?i)opinion|editorial|commentary'), false) as opm,
  {_WORDING(V.OPINION_PATTERN)} as opt, {_WORDING(V.NEGATION_PATTERN)} as neg, {_WORDING(V.REFUTATION_PATTERN)} as ref,
  coalesce({', '.join(_year_month(c) for c in ('time', 'claim_date', 'text'))}) as ym, coalesce({', '.join(_first(c, _whole(r'((?:19|20)[0-9]{2})'), 1) for c in ('time', 'claim_date', 'text'))}) as yr,
  list_max(list_filter(list_transform(regexp_extract_all(text, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda n: replace(n, ',', '')::double), lambda v: not (v = floor(v) and v between 1900 and 2099))) as num,
  list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(regexp_extract(text, '{_PERSON}', 1), ''), '[^A-Za-z\s]', ' ', 'g')), '\s+'), lambda w: w <> '') as per,
  nullif(lower(trim(subject)), '') as sub,
  list_distinct(flatten(list_transform(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z'']+'), lambda w: length(w) >= 4 and not list_contains({strings(V.CONTENT_STOPWORDS)}, w))),
    lambda w: list_filter([w, {_CUT}], lambda x: x is not null)))) as con from hosted)"""

_ROLE = lambda x, names: f"coalesce(list_contains({strings(names)}, {x}.role), false)"
TYPED = rf"""{SIGNALS}, {FEATURES},
met as (select s.*, a.claim_id is null or b.claim_id is null as missing, {_ROLE("a", V.CLAIM_ROLES)} as ac, {_ROLE("b", V.CLAIM_ROLES)} as bc, {_ROLE("a", V.EVIDENCE_ROLES)} as ae, {_ROLE("b", V.EVIDENCE_ROLES)} as be,
  len(list_intersect(a.con, b.con)) as same, abs(a.auth - b.auth) as gap, greatest(abs(a.num), abs(b.num)) as larger, abs(a.num - b.num) as apart, a.auth as aauth, b.auth as bauth, a.ref as aref, b.ref as bref, a.neg as aneg, b.neg as bneg,
  b.dom as bdom, a.ym <> b.ym as yms, a.yr <> b.yr as yrs, a.sub as asub, b.sub as bsub, len(a.per) >= 2 and len(b.per) >= 2 and a.per <> b.per and a.per[1] = b.per[1] and a.per[-1] = b.per[-1] as names,
  a.opm or b.opm as opm, a.opt or b.opt as opt
  from sig s left join feat a on a.payload_id = s.payload_id and a.claim_id = s.a left join feat b on b.payload_id = s.payload_id and b.claim_id = s.b),
flags as (select *, signal in ('agreement', 'neutral') as calm, coalesce(gap >= 0.35, false) as wide,
  coalesce(not coalesce(nli_label = 'entailment', false) and same > 0 and (((aref or bref) and same >= 2) or (aneg <> bneg and same >= 4)), false) as lexical,
  coalesce(nli_label is null and gap >= 0.55 and aauth <= 0.25 and bauth >= 0.7 and not bneg and not bref and bdom >= 0.8, false) as gapped,
  coalesce(yms, false) or coalesce(yrs, false) as times, coalesce(larger > 0 and apart >= 0.1 * larger, false) as numbers,
  case when asub is not null and bsub is not null then asub <> bsub else coalesce(names, false) end as subjects from met),
ruled as (select *, case when missing then 'missing' when signal = 'unrelated' then 'unrelated' when calm and not lexical and not gapped then 'calm' when times then 'time' when numbers then 'number' when subjects then 'subject'
    when opm then 'opinion_medium' when wide and calm and gapped and not lexical then 'source_gap' when wide then 'authority_gap' when opt then 'opinion_text' else 'signal' end as rule,
  case when signal = 'conflict' then 0.6 when signal = 'inconclusive' then 0.5 when lexical then 0.45 else 0.5 end as base from flags),
typed as (select payload_id, pair_no, a as claim_a_id, b as claim_b_id, nli_label, null::varchar as stance, signal, rule,
  case when ac and not bc then 'a_as_claim' when bc and not ac then 'b_as_claim' when ae and not be then 'b_as_claim' when be and not ae then 'a_as_claim' else 'bidirectional' end as direction,
  (case when missing or nli_label is null or nli_label not in ('entailment', 'contradiction', 'neutral') then 0.0 else 0.6 end)::double as fusion_confidence,
  case rule when 'missing' then 'ambiguity' when 'unrelated' then 'noise' when 'calm' then 'none' when 'time' then 'temporal_conflict' when 'number' then 'ambiguity' when 'subject' then 'ambiguity' when 'opinion_medium' then 'opinion_conflict'
    when 'source_gap' then 'ambiguity' when 'authority_gap' then 'misinformation' when 'opinion_text' then 'opinion_conflict'
    else case when signal = 'conflict' or (signal = 'agreement' and lexical) then 'hard_contradiction' else 'ambiguity' end end as conflict_type,
  round((case rule when 'missing' then 0.1 when 'unrelated' then 0.8 when 'calm' then 0.8 when 'time' then least(0.9, base + 0.2) when 'number' then least(0.8, base + 0.15) when 'subject' then least(0.85, base + 0.2)
    when 'opinion_medium' then least(0.75, base + 0.1) when 'source_gap' then least(0.7, base + 0.15) when 'authority_gap' then least(0.8, base + 0.15) when 'opinion_text' then least(0.7, base + 0.1) else base end)::double, 4) as confidence
  from ruled),
pairs as (select *, {_case('conflict_type', V.CONFLICT_POLICIES)} as policy from typed)"""

ORACLES = {
    "source_media": f"""with newest as (select payload_id, null as claim_id, unnest(claims) as c from p1_payload), {_HOSTED} select kind as medium, dom as host_authority, count(*) as claims from hosted group by all""",
    "conflict_types": f"with {TYPED} select payload_id, pair_no, claim_a_id, claim_b_id, nli_label, stance, direction, signal, fusion_confidence, conflict_type, confidence, policy, rule from pairs",
    "type_counts": f"with {TYPED} select conflict_type, rule, count(*) as pairs from pairs group by all",
    "type_maps": f"""with {TYPED}, n as (select payload_id, conflict_type, count(*) as n from pairs group by all)
        select payload_id, string_agg(conflict_type || '=' || n, '|' order by conflict_type) as types from n group by payload_id""",
    "rule_fires": f"""with {TYPED}, r as (select unnest(['missing', 'unrelated', 'calm', 'time', 'number', 'subject', 'opinion_medium', 'source_gap', 'authority_gap', 'opinion_text', 'signal']) as rule),
        n as (select r.rule as rule, count(p.rule) as fired from r left join pairs p on p.rule = r.rule group by r.rule)
        select rule, fired, case when fired = 0 then 'DEAD' when 2 * fired > (select count(*) from pairs) then 'DOMINANT' end as tag from n""",
    "conflict_summary": f"""with {TYPED}, n as (select payload_id, policy, count(*) as n, min(pair_no) as seen from pairs group by all),
        m as (select payload_id, policy as primary_policy from (select *, row_number() over (partition by payload_id order by n desc, seen) as k from n) where k = 1),
        s as (select payload_id, count(*) as pairs, round(avg((conflict_type = 'hard_contradiction')::int), 6)::double as contradiction_ratio, round(avg((confidence < 0.45)::int), 6)::double as low_confidence_ratio,
          round(sum((confidence * 10000)::decimal(18, 4)::bigint)::double / count(*) / 10000, 6)::double as mean_confidence from pairs group by payload_id),
        d as (select s.*, primary_policy, primary_policy = 'abstain' or contradiction_ratio >= 0.5 or (low_confidence_ratio >= 0.6 and mean_confidence <= 0.5) as abstain from s join m using (payload_id))
        select *, case when abstain then 'abstain_with_explanation' else {_case('primary_policy', V.POLICY_STRATEGIES)} end as strategy from d""",
}
