import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimspan.llm import container_packing as cp
from claimspan.llm.source_mixing import mix, share_report
from claimspan.llm.token_sizes import TOKENIZER, TokenCounter, token_sizes


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .'\n\t語é  s", max_size=40))
def test_word_sums_are_exact(text):
    counter = TokenCounter.load(TOKENIZER)
    assert counter.count(text) == counter.encode_length(text)


def test_sizes_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "two words", "x"), (4, "word " * 300_000, "x")], "doc_id bigint, text string, n string")
    got = {r.doc_id: r.n_tokens for r in token_sizes(df).collect()}
    assert got[1] is None and got[2] == 0 and got[3] == 2 and got[4] >= 300_000
    assert token_sizes(df.limit(0)).count() == 0


@pytest.mark.parametrize("histogram, capacity, best", [({520: 1000, 500: 1000}, 1024, 1000), ({6: 600, 4: 600, 5: 200}, 10, 700), ({7: 100, 3: 300, 2: 50}, 10, 175), ({1024: 3}, 1024, 3), ({}, 10, 0)])
def test_fillings_are_complete_and_tight(histogram, capacity, best):
    fillings = cp.plan_fillings(histogram, capacity)
    used = Counter()
    for f in fillings:
        assert sum(s * n for s, n in f.items) <= capacity
        for s, n in f.items:
            used[s] += n * f.times
    assert used == Counter(histogram)
    assert best <= sum(f.times for f in fillings) <= best + 1 + best // 50


def sampled(sizes, items=20_000):
    rng = random.Random(0)
    return Counter(rng.choice(sizes) for _ in range(items))


@pytest.mark.parametrize(
    "histogram, capacity",
    [(sampled([90, 130, 170, 210, 260, 310, 370, 440, 510]), 1000), (sampled(range(250, 501)), 1000), (sampled([334, 335, 600, 666, 200]), 1000), (sampled(range(1, 1001), 3000), 1000), ({520: 1000, 500: 1000}, 1024)],
)
def test_program_converges_and_rounding_keeps_to_it(histogram, capacity):
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[int(s)] for s in lengths], float)
    program = cp.solve_program(lengths, need, capacity)
    group = cp.size_classes(lengths, need)
    assert (program.amounts @ program.fillings >= np.bincount(group, need) * (1 - 1e-9)).all()  # every class is covered
    assert (program.fillings @ program.classes <= capacity).all() and len(program.amounts) <= len(program.classes)
    assert lengths @ need / capacity - 1e-6 <= program.bound <= program.value + 1e-6
    used = sum(f.times for f in cp.plan_fillings(histogram, capacity))
    largest_first = sum(n for _, n in cp._largest_first(lengths[::-1], need[::-1].astype(np.int64), capacity))
    assert program.bound <= used <= min(largest_first, program.value + len(program.classes))
    if len(lengths) <= 9:
        assert program.value <= program.bound * 1.035


def test_reduced_solution_costs_no_more():
    rng = np.random.default_rng(0)
    rows, amounts = rng.integers(0, 4, (60, 7)), rng.random(60)
    fewer, left = cp.few_fillings(rows, amounts)
    assert len(left) <= 7 and left.sum() <= amounts.sum() + 1e-9
    assert np.allclose(left @ fewer, amounts @ rows)


def packed(spark, rows, capacity):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, n_tokens bigint, container_id string")
    return cp.pack(df, capacity).collect()


def test_every_item_once_and_nothing_overfull(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 40, 40, 41, 99, 100, 101, 250, None])) for i in range(500)] + [(7, 40), (7, 40)]
    out = packed(spark, rows, 100)
    load, whole = Counter(), Counter()
    for r in out:
        load[r.container_id] += r.n_tokens
        whole[r.doc_id] += r.n_tokens
        assert r.n_tokens <= 100 and r.token_start % 100 == 0
    assert max(load.values()) <= 100
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert +whole == +want
    assert len([r for r in out if r.doc_id == 7]) >= 2
    assert len(+load) <= -(-sum(want.values()) // 100) * 1.06 + 1
    assert packed(spark, [], 100) == [] and packed(spark, [(1, 0)], 100)[0].container_id == 0


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)]


def test_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.randint(1, 60)) for i, s in enumerate(["a"] * 4000 + ["b"] * 900 + ["c"] * 3000 + ["unlisted"] * 50)]
    rows += [(10_000, None, 5), (10_001, "a", None), (10_002, "a", 0), (0, "a", 10)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").repartition(5).withColumn("h", F.lit("clash"))
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mix(sizes, targets)
    got = mixed.collect()
    have, used = Counter(), Counter()
    for _, s, n in rows:
        have[s] += n or 0
    for r in got:
        assert 1 <= r.repeats <= {t[0]: t[2] for t in TARGETS}[r.source] and r.n_tokens > 0
        used[r.source] += r.repeats * r.n_tokens
    total = min(m * have[s] / share for s, share, m in TARGETS if have[s])
    for s, share, _ in TARGETS[:3]:
        assert total * share - 200 <= used[s] <= total * share + 1e-3
    report = {r.source: r for r in share_report(mixed, targets).collect()}
    assert report["gone"].tokens == 0 and abs(report["a"].actual_share - 0.5 / 0.9) < 0.01
    assert mix(sizes.limit(0), targets).count() == 0


def test_one_huge_document_and_a_hot_source(spark):
    rows = [(1, "a", 1_000_000)] + [(i, "b", 10) for i in range(2, 3000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix(sizes, targets).collect()
    assert {r.source for r in got} == {"b"} and len(got) == 2998
