import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspan.llm.cohesion_split import BLOCK, _climb, gap_depths, sentence_gaps, split_oversized, split_text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n。é語", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces_fit_and_cover(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(end - start <= limit for start, end, _ in pieces)
    for (_, end, _), (start, next_end, _) in zip(pieces, pieces[1:], strict=False):
        assert start == end - overlap >= 0 and next_end > end


def test_topic_valley_is_chosen():
    cats = "The cat chased the mouse. A cat sleeps on the mat. The mouse fears the cat. " * 3
    banks = "The bank raised interest rates. Interest on bank loans grew. Loans need a bank. " * 3
    pieces = split_text(cats + banks, len(cats) + 100, 0)
    assert pieces[0] == (0, len(cats), "topic")


def test_planted_topic_changes_are_found():
    rng = random.Random(5)
    hits = cuts = 0
    for _ in range(30):
        text, changes = "", set()
        for topic in range(12):
            words = [f"w{topic}{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(25)]
            for _ in range(rng.randint(8, 14)):
                sentence = [*rng.sample(words, 5), *rng.choices("the of and in to was for with".split(), k=4)]
                rng.shuffle(sentence)
                text += " ".join(sentence) + ". "
            changes.add(len(text))
        for _, end, how in split_text(text, 1500, 0)[:-1]:
            cuts += 1
            hits += how == "topic" and end in changes
    assert cuts > 150 and hits / cuts >= 0.9


def test_depths_are_the_cosines_of_the_blocks_around():
    rng = random.Random(2)
    text = " ".join(" ".join(rng.choices("cat dog bank loan mouse rate".split(), k=rng.randint(0, 6))) + "." for _ in range(60)) + " end"
    gaps = sentence_gaps(text)
    gaps = gaps[gaps < len(text)]
    edges = [0, *gaps.tolist(), len(text)]
    bags = [Counter(re.findall(r"[a-z]{2,}", text[a:b])) for a, b in zip(edges, edges[1:])]
    weight = {w: 1 + round(1000 * np.log((1 + len(bags)) / sum(w in b for b in bags)) ** 2) for w in sum(bags, Counter())}
    curve = []
    for at in range(1, len(bags)):
        left, right = (sum(part, Counter()) for part in (bags[max(0, at - BLOCK) : at], bags[at : at + BLOCK]))
        norm = sum(weight[w] * x * x for w, x in left.items()) * sum(weight[w] * x * x for w, x in right.items())
        curve.append(sum(weight[w] * left[w] * right[w] for w in left) / norm**0.5 if norm else 0.0)
    want = _climb(np.array(curve)) + _climb(np.array(curve[::-1]))[::-1]
    assert np.allclose(gap_depths(text, gaps), want)


def test_long_clusters_stay_whole():
    text = "a" + "\u0301" * 200 + "b" * 300
    assert split_text(text, 250, 0)[0] == (0, 250, "none") and text[250] == "b"
    cluster = "b" * 100 + "a" + "\u0301" * 200 + "b" * 300
    assert split_text(cluster, 250, 0)[0] == (0, 100, "none")


def test_unbroken_runs_and_bad_limits():
    assert [p[2] for p in split_text("x" * 100, 40, 10)] == ["none", "none", "end"]
    assert "".join("é" * 50 for _ in "a")[: split_text("é" * 50, 41, 3)[0][1]].endswith("́")
    with pytest.raises(ValueError):
        split_text("x", 5, 5)


def test_edges(spark):
    items = spark.createDataFrame(
        [("t", "a", "f", "short", 1), ("t", "b", "f", None, 2), ("t", "c", "f", "word " * 50, 3), ("t", "c", "f", "word " * 50, 3), ("t", "d", "other", "word " * 50, 4), ("t", "e", "f", "", 5), ("t", "g", "f", "z" * 2_000_000, 6)],
        "table_name string, item_key string, field_name string, text string, max_size int",
    ).drop("max_size").withColumnRenamed("item_key", "item_key")
    limits = spark.createDataFrame([("f", 100, 20, "clash")], "field_name string, max_size bigint, overlap_size bigint, table_name string")
    out = split_oversized(items, limits)
    rows = out.where("item_key = 'c'").collect()
    assert {r.item_key for r in out.select("item_key").distinct().collect()} == {"c", "g"}
    assert len(rows) % 2 == 0 and all(len(r.piece) == r.char_end - r.char_start <= 100 for r in rows)
    assert split_oversized(items.limit(0), limits).count() == 0
