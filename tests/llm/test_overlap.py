import random
from collections import Counter

from claimspan.llm import split_overlap as so

SCHEMA = "record_id bigint, split string, claim string, words string"
BASE = "Voters in Kastholm rejected the old museum collection proposed by Yorik Chizia with a majority of 1,779 votes."


def run(spark, rows):
    return sorted((r.record_id_a, r.record_id_b) for r in so.cross_split_pairs(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).select("record_id_a", "record_id_b").collect())


def test_edits_names_and_figures(spark):
    others = [
        (2, "dev", BASE), (3, "dev", BASE.upper()), (4, "test", BASE.replace("rejected the", "rejectd")), (5, "dev", BASE.replace("Kastholm", "Berglund")),
        (6, "dev", BASE.replace("1,779", "1,778")), (7, "dev", BASE.replace("1,779", "1779")), (8, "train", BASE), (9, "dev", None), (10, "dev", ""), (11, None, BASE),
        (12, "dev", "..."), (13, "dev", "with a majority of 1779 votes Voters in Kastholm rejected the old museum collection proposed by Yorik Chizia"),
        (14, "test", BASE.replace("old museum collection proposed", "new library archive backed").replace("rejected", "liked")), (2, "dev", BASE),
        (15, "test", "word " * 5000), (16, "train", "word " * 5000 + "more"),
    ]
    rows = [(1, "train", BASE), *others]
    matches = [2, 3, 4, 7, 13]
    want = sorted([(1, x) for x in matches] + [(min(8, x), max(8, x)) for x in matches] + [(15, 16)])
    assert run(spark, rows) == want
    assert run(spark, []) == []
    assert run(spark, [r for r in rows if r[1] != "train"]) == []


def test_prefix_filter_loses_nothing(spark):
    """Against all pairs by the same final rule, on random small vocabularies where overlap is frequent."""
    rng = random.Random(5)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(3, 14))]
        rows.append((i, rng.choice(["train", "dev", "test"]), " ".join(text)))
    want = []
    for a, sa, ta in rows:
        for b, sb, tb in rows:
            x, y = Counter(ta.split()), Counter(tb.split())
            if sa == "train" and sb != "train" and 5 * sum((x & y).values()) >= 4 * max(sum(x.values()), sum(y.values())):
                want.append((min(a, b), max(a, b)))
    assert run(spark, rows) == sorted(want)


def test_words_are_normalised():
    words, written, figures = so.statement_words("Élan paid 12 345,6 to 1.234 people in 1984")
    assert words == ["elan", "paid", "12345", "6", "to", "1234", "people", "in", "1984"] or figures
    assert so.one_slip("federal", "fedral") and so.one_slip("were", "weer") and not so.one_slip("bank", "council")
    assert so.statement_words("价格为63.6亿元")[2] == ["63.6"]


def test_han_names_differ_and_common_characters_do_not():
    items = lambda words: [{"at": i, "name_kind": 0} for i in range(len(words))]
    one, name, common = list("因为泽维堡的价格上涨"), list("因为泽瓦堡的价格上涨"), list("由为泽维堡的价格上涨")
    assert (("维", 2) in so.left_over(one, items(one), name)) and ("瓦", 2) in so.left_over(name, items(name), one)
    assert so.left_over(one, items(one), common) == [("因", 0)]


def test_counts_from_class_sizes_are_those_of_the_pairs(spark):
    rng = random.Random(8)
    texts = [BASE, BASE.upper(), BASE.replace("rejected the", "rejectd"), BASE.replace("Kastholm", "Berglund"), "Other words about the harbour were said in 1999."]
    rows = [(i, rng.choice(["train", "dev", "test"]), rng.choice(texts), rng.choice(["a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, claim string, origin string")
    origin = {r[0]: r[3] for r in rows}
    want: dict = {}
    for r in so.cross_split_pairs(df).collect():
        held = want.setdefault((r.eval_split, origin[r.eval_id]), [0, set(), set(), 0])
        held[0] += 1
        held[1].add(r.eval_id)
        held[2].add(r.train_id)
        held[3] += r.shared == r.longest
    got = {(r.eval_split, r.origin): (r.pairs, r.eval_records, r.train_records, r.equal_pairs) for r in so.overlap_counts(df, "origin").collect()}
    assert got == {k: (n, len(e), len(t), q) for k, (n, e, t, q) in want.items()} and len(got) > 3
