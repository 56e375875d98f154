import json
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from claimspan.llm.canonical_copies import canonical_text, copies_of, decode, decode_deep, dictionary, distinct_records, numbered_records, record_pairs


def plain_canon(text):
    text, out = text.lower(), []
    for i, ch in enumerate(text):
        kind = unicodedata.category(ch)[0]
        between = 0 < i < len(text) - 1 and all(unicodedata.category(c) == "Nd" for c in (text[i - 1], text[i + 1]))
        if kind in "LMN" or (kind in "PS" and between):
            out.append(ch)
    return "".join(out)


def plain_json(x):
    if isinstance(x, dict):
        return "o", tuple(sorted((k, plain_json(v)) for k, v in x.items()))
    if isinstance(x, list):
        return "l", tuple(map(plain_json, x))
    if isinstance(x, bool) or x is None:
        return "c", str(x)
    return ("n", float(x)) if isinstance(x, int | float) else ("s", plain_canon(x))


TEXTS = ["Hello, World!", "hello world", "HELLO  WORLD ", None, "", "...", "1,234", "1234", "1 234", "3.5%", "3..5", "3.5", "नमस्ते दुनिया", "नमस्ते,दुनिया", "नमसत दनय", "x" * 200_000, "X" * 200_000 + "!", "a_b", "ab", "½", "1😂2", "12", "1\U000f0041b", "1b", "٣.٤", "٣٤"]
BODIES = ['{"a": 1, "b": [1, 2]}', '{"b":[1.0,2e0],"a":1}', '{"b": [2, 1], "a": 1}', '{"a": 1, "b": [1, 2], "c": null}', '{"a": "1", "b": [1, 2]}', '{"a": {"x": "Hi!"}}', '{"a": {"x": "hi"}}', '{"a": {}}', '{"a": []}', '{"a": true}', '{"a": "True"}', "[1]", "{broken", None, "", '{"a": 0}', '{"a": -0.0}', '{}']


def check(spark, rows, as_json):
    df = spark.createDataFrame(rows, "k bigint, v string, record string").repartition(3)
    records = numbered_records({"t": record_pairs(df, "k", "v", as_json)})
    groups = defaultdict(list)
    for k, v, _ in rows:
        if v and as_json:
            try:
                held = json.loads(v)
            except ValueError:
                continue
            if isinstance(held, dict):
                groups[plain_json(held)].append(str(k))
        elif v and plain_canon(v):
            groups[plain_canon(v)].append(str(k))
    want = sorted((min(g), k) for g in groups.values() for k in g if k != min(g))
    assert sorted((r.kept_key, r.copy_key) for r in copies_of(records).collect()) == want
    assert sorted((r.kept_key, r.copies) for r in distinct_records(records).collect()) == sorted((min(g), len(g)) for g in groups.values())


def test_texts_and_edges(spark):
    check(spark, [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100 + i, t, "clash") for i, t in enumerate(TEXTS[:3])], False)
    check(spark, [], False)


def test_json_records(spark):
    check(spark, [(i, t, "clash") for i, t in enumerate(BODIES)] + [(0, BODIES[0], "again")], True)


def test_canonical_text_is_the_rule():
    for t in TEXTS:
        if t:
            assert canonical_text(t) == plain_canon(t)


def test_hot_group_goes_through_the_broadcast_join(spark):
    text = F.expr("if(id % 3 = 0, 'hot', concat('text ', id div 2))")
    df = spark.range(30_000).select(F.col("id").cast("string").alias("k"), text.alias("v"))
    assert copies_of(numbered_records({"t": record_pairs(df, "k", "v")})).count() == 30_000 - df.select("v").distinct().count()


def test_nesting_of_any_depth(spark):
    deep = lambda x, n=50_000: '{"a": ' + "[" * n + x + "]" * n + "}"
    rows = [(1, deep('"Hi!"')), (2, deep(' "hi" ')), (3, deep('"ho"')), (4, deep('"hi"', 49_999)), (5, deep('{"b": 1}')), (6, deep('{"b":1.0}')), (7, deep('"hi"')[:-1])]
    df = spark.createDataFrame(rows, "k bigint, v string")
    got = sorted(tuple(r)[1:] for r in copies_of(numbered_records({"t": record_pairs(df, "k", "v", True)})).collect())
    assert got == [("1", "2"), ("5", "6")]


def test_deep_decoder_is_the_same():
    for body in [*BODIES, '{"a": {"b": [1, -2.5e3, true, null, "x\\n\\u00e9"], "a": {}}, "a": []}']:
        if body and body != "{broken":
            assert decode_deep(body) == decode(body)


def test_dictionary_numbers_shared_pairs_only(spark):
    rows = [(i, json.dumps({"a": i % 50, "b": i, "c": {"d": "Same!"}})) for i in range(200)]
    records = numbered_records({"t": record_pairs(spark.createDataFrame(rows, "k bigint, v string"), "k", "v", True)})
    found = dictionary(records).collect()
    assert sorted(r.number for r in found) == list(range(1, 52)) and sorted(r.uses for r in found) == [4] * 50 + [200]
    assert copies_of(records).count() == 0


def test_many_fields_are_compared_as_tuples(spark):
    wide = {f"field {i}": f"value {i % 7}" for i in range(400)}
    other = wide | {"field 399": "value 1"}
    rows = [(1, json.dumps(wide)), (2, json.dumps(dict(reversed(wide.items()))).upper().replace("FIELD", "field")), (3, json.dumps(other)), (4, json.dumps(other | {"more": None}))]
    df = spark.createDataFrame(rows, "k bigint, v string")
    assert [tuple(r)[1:] for r in copies_of(numbered_records({"t": record_pairs(df, "k", "v", True)})).collect()] == [("1", "2")]


def test_whole_tables_against_brute_force(spark):
    from claimspan.llm.copies_queries import p3_found

    folder, want = "/root/testdata/sf0.001", set()
    sources = (("documents", "doc_id", "text"), ("document_records", "doc_id", "full_text"), ("claim_lines", "line_id", "body"))
    for table, key, text in sources:
        groups = defaultdict(list)
        for k, v in spark.read.parquet(f"{folder}/{table}.parquet").select(F.col(key).cast("string"), text).collect():
            form = plain_json(json.loads(v)) if table == "claim_lines" else plain_canon(v or "")
            if form:
                groups[form].append(k)
        want |= {(table, min(g), k) for g in groups.values() for k in g if k != min(g)}
    got = {tuple(r) for r in p3_found(spark, folder).where("table_name <> 'benchmark_rows'").collect()}
    assert got == want
