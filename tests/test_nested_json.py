"""The structural index against the json module, and the flat tables against a brute-force reader."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from claimspan.operators import nested_json as nj
from claimspan.operators.structural_json import StructuralIndex


def whole(text):
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False
    return True


values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.booleans(), st.integers(0, 200)), min_size=1, max_size=5))
def test_validity_and_spans_agree_with_json(documents):
    texts = []
    for value, ascii_only, keep in documents:
        text = json.dumps(value, ensure_ascii=ascii_only, indent=1 if keep % 2 else None)
        texts.append(text if keep > 100 else text[:keep])
    index = StructuralIndex([t.encode("utf-8", "surrogatepass") for t in texts])
    for doc, text in enumerate(texts):
        assert bool(index.valid[doc]) == whole(text), text
        if index.valid[doc]:
            root = index.root(doc)
            assert json.loads(index.text(root)) == json.loads(text)
            held = json.loads(text)
            if isinstance(held, list):
                assert [json.loads(index.text(c)) for c in index.children(root)] == held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='{}[]:,"\\u0a1-. tn', max_size=12), min_size=1, max_size=6))
def test_random_punctuation_is_judged_as_json_judges_it(texts):
    index = StructuralIndex([t.encode() for t in texts])
    for doc, text in enumerate(texts):
        assert bool(index.valid[doc]) == whole(text), text


def brute(record_id, body):
    if body is None:
        return set()
    try:
        held = json.loads(body.lstrip("﻿"))
    except ValueError:
        return set()
    if isinstance(held, list):
        records = held
    elif isinstance(held, dict):
        records = next((held[w] for w in nj.WRAPPERS if isinstance(held.get(w), list)), [held])
    else:
        records = []

    def as_list(x):
        if isinstance(x, str):
            try:
                inner = json.loads(x)
            except ValueError:
                return [x]
            return inner if isinstance(inner, list) else [x]
        return x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    out = set()
    for no, r in enumerate(records):
        if not isinstance(r, dict):
            continue
        for section, kind in (("claims", "claim"), ("nli_results", "nli_result")):
            out |= {(record_id, no, kind, 0, i) for i, x in enumerate(as_list(r.get(section))) if x is not None}
        for q, question in enumerate(as_list(r.get("questions"))):
            if isinstance(question, dict):
                out |= {(record_id, no, "answer", q, i) for i, x in enumerate(as_list(question.get("answers"))) if x is not None}
    return out


BODIES = [
    None, "", "{", "[]", "null", '"x"', "3", '{"questions": null}', '{"claims": [null, {"claim_id": "a"}, "bare"]} ', "[1, null, {\"claims\": {\"claim_id\": 1}}]",
    '{"data": [{"questions": "[{\\"answers\\": \\"[{\\\\\\"answer\\\\\\": 1}]\\"}, null]"}]}', '{"questions": [{"answers": "plain"}, {"answers": ["x", null, {}]}, null]}',
    '﻿{"records": [null, {"nli_results": [null, {"label": "neutral"}]}]}', '{"nli_results": 3, "claims": "[broken"}', '{"claims": [], "claims": [1]}', '{"a": 1} x',
    '{"questions": {"answers": {"answer": "a\\u00e9\\ud83d\\ude00"}}}', "[" * 300 + "]" * 300, '{"claims": "[]", "x": "' + "y" * 100_000 + '"}',
]


def test_edges_against_brute_force(spark):
    rows = [(i, b, "clash") for i, b in enumerate(BODIES)] + [(3, BODIES[8], "again")]
    df = spark.createDataFrame(rows, "record_id bigint, body string, value string").repartition(3)
    nodes = nj.flatten_records(df)
    got = sorted(tuple(r) for r in nodes.where("node_kind in ('answer', 'claim', 'nli_result')").drop("value_kind", "value").collect())
    assert got == sorted(x for i, b, _ in rows for x in brute(i, b))
    assert nj.flatten_records(df.limit(0)).count() == 0
    answers = {(r.record_id, r.question_no, r.answer_no): r.answer for r in nj.answers_table(nodes).collect()}
    assert answers[16, 0, 0] == "aé😀" and answers[11, 0, 0] == "plain" and answers[11, 1, 2] is None
    assert nj.claims_table(nodes).where("record_id = 8").count() == 2


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet")
    got = {tuple(r) for r in nj.flatten_records(df).where("node_kind in ('answer', 'claim', 'nli_result')").drop("value_kind", "value").collect()}
    assert got == {x for r in df.collect() for x in brute(r.record_id, r.body)}
