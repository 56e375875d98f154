import random
from datetime import datetime

import pytest

from claimspan.operators.orphans import find_orphans, payload_orphans

T = [datetime(2025, 1, d) for d in range(1, 10)]
KEYS = ["a", "b"]


def brute(refs, targets, match):
    out = []
    for n, a, b, t in refs:
        live = lambda x: (x[2] is None or x[2] <= t) and (x[3] is None or x[3] > t)
        nulls = (a is None) + (b is None)
        if nulls == 2 or (nulls and match == "simple"):
            continue
        if nulls and (match == "full" or not any(live(x) for x in targets if (a is None or x[0] == a) and (b is None or x[1] == b) and None not in x[:2])):
            out.append((n, "partial"))
        if not nulls:
            mine = [x for x in targets if x[:2] == (a, b)]
            if any(x[3] is not None and x[3] <= t for x in mine):
                out.append((n, "deleted"))
            elif not mine:
                out.append((n, "missing"))
            elif min(x[2] for x in mine) > t:
                out.append((n, "late"))
    return sorted(out)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_masks_times_and_rules(spark, match):
    targets = [("s", "1", T[2], None), ("s", "1", T[4], None), ("s", "2", T[0], T[3]), ("u", "1", T[5], None), ("v", None, T[0], None)]
    refs = [(i, a, b, t) for i, (a, b, t) in enumerate((a, b, t) for a in ("s", "u", "w", None) for b in ("1", "2", "9", None) for t in (T[0], T[3], T[7]))]
    refs.append(refs[0])
    schema = "n int, a string, b string, at timestamp"
    r = spark.createDataFrame(refs, schema)
    t = spark.createDataFrame([(*x, "clash") for x in targets], "a string, b string, valid_from timestamp, valid_until timestamp, n string")
    got = sorted((x.n, x.reason) for x in find_orphans(r, t, KEYS, "at", match).collect())
    assert got == brute(refs, targets, match)
    none = find_orphans(r.limit(0), t, KEYS, "at", match)
    assert none.count() == 0
    everything = find_orphans(r, t.limit(0), KEYS, "at", match).where("null_mask = 0")
    assert everything.count() == 28 and {x.reason for x in everything.collect()} == {"missing"}


def test_partial_match_over_many_overlapping_intervals(spark):
    rng = random.Random(6)
    day = lambda: datetime(2025, rng.randint(1, 2), rng.randint(1, 28), rng.randint(0, 3))
    targets = [("hot", str(i), rng.choice([None, day()]) if i % 9 == 0 else day(), day() if i % 40 else None) for i in range(120)] + [("cold", "1", day(), day())]
    refs = [(i, rng.choice(["hot", "cold", "gone"]), None, rng.choice([None, day(), day(), day()])) for i in range(400)]
    r = spark.createDataFrame(refs, "n int, a string, b string, at timestamp")
    t = spark.createDataFrame([x for x in targets if x[2]], "a string, b string, valid_from timestamp, valid_until timestamp")
    live = lambda x, at: at is None or (x[2] <= at and (x[3] is None or x[3] > at))
    want = [n for n, a, _, at in refs if not any(x[0] == a and x[2] and live(x, at) for x in targets)]
    assert sorted(x.n for x in find_orphans(r, t, KEYS, "at", "partial").collect()) == want


def test_unknown_rule_is_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        find_orphans(df, df, ["a"], match="loose")


def test_payloads(spark):
    schema = (
        "payload_id bigint, sample_id string, claims array<struct<claim_id: string>>, candidate_pairs array<struct<claim_a_id: string, claim_b_id: string>>,"
        "nli_results array<struct<claim_a_id: string, claim_b_id: string, label: string>>, delivered_at timestamp, reason string"
    )
    rows = [
        (1, "s", [("c1",), ("c2",), (None,)], [("c1", "c3"), None, ("c2", None)], None, T[1], "clash"),
        (2, "s", [("c3",)], None, [("c3", "c9", "x"), ("C1", "c1", None)], T[2], None),
        (3, "t", None, [("c1", "c1")], [], T[3], None),
        (3, "t", None, [("c1", "c1")], [], T[3], None),
    ]
    gone = spark.createDataFrame([(1, "s", "c2", T[1], "x"), (2, "s", "c3", T[5], None), (3, None, None, None, None)], "retraction_id bigint, sample_id string, claim_id string, retracted_at timestamp, reason string")
    payloads = spark.createDataFrame(rows, schema).drop("reason")
    got = sorted((r.payload_id, r.section, r.item_no, r.side, r.reason) for r in payload_orphans(payloads, gone).collect())
    pair = lambda p, i, s, why: (p, "candidate_pairs", i, s, why)
    assert got == sorted(
        [pair(1, 0, "b", "late"), pair(1, 2, "a", "deleted"), (2, "nli_results", 0, "b", "missing"), (2, "nli_results", 1, "a", "missing")]
        + 2 * [pair(3, 0, "a", "missing"), pair(3, 0, "b", "missing")]
    )
