"""Same or near-same statements across splits, by an exact prefix-filter join.

A statement is its multiset of normalised words (single Han characters for Chinese). Two statements match when they
share at least ``SHARE`` of the longer one's words, have the same figures, and differ in no name. Only evaluation
statements are indexed and only training statements probe, so nothing is paired inside a split.

Exactness of the candidate search: if two sets of n and m words share at least ceil(SHARE * max(n, m)) of them, then
under any common order their prefixes of n - ceil(SHARE * n) + 1 and m - ceil(SHARE * m) + 1 words have a word in
common. The common order is rarest first, by document frequency over the whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, join_one_sided_hot

#: At most one word in five may differ: shared words over the words of the longer statement.
SHARE_NUMERATOR, SHARE_DENOMINATOR = 4, 5
_GROUPED = re.compile("(?<!\\d)(\\d{1,3})((?:[,.'\\u2019\\u00a0\\u202f\\u2009 ]\\d{3})+)(?!\\d)")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[㐀-鿿豈-﫿]|[^\W\d_㐀-鿿豈-﫿][^\W\d_㐀-鿿豈-﫿]*")
# Characters commonly used to write foreign names in Chinese by sound.
NAME_CHARACTERS = frozenset(
    "阿埃艾安奥巴白班邦堡贝比宾波伯博布查达戴丹道德登迪蒂丁杜顿多恩尔法范费菲芬丰弗福富盖甘冈格根古圭哈海汉豪赫黑亨胡华霍基吉加贾杰金卡凯坎康考柯科克肯库奎拉莱兰朗劳勒雷里利莉连廉林琳留龙卢鲁伦罗洛马玛迈麦曼芒毛梅门蒙米密明莫默姆木穆纳娜乃南内尼宁努诺欧帕潘庞培佩彭皮平珀浦普奇齐钱乔切琼让日荣茹瑞若撒萨塞赛桑瑟沙莎舍申圣施什舒朔斯松苏孙索塔泰坦汤唐特滕提廷图托瓦万旺威韦维魏温文沃乌武西希锡夏香肖谢欣辛休许逊雅亚延扬耶叶伊因英尤于约泽扎詹兹佐"
)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def statement_words(text: str) -> tuple[list[str], list[int], list[str]]:
    """Words in order (accents and digit grouping removed, lower case), how each is written (1 capital, 0 not, -1 no
    evidence: first word, or no lower case anywhere), and the figures, sorted."""
    text = _GROUPED.sub(lambda m: m[1] + re.sub(r"\D", "", m[2]), _plain(text))
    raw = _TOKEN.findall(text)
    letters = [w for w in raw if w[0].isalpha() and len(w) > 1]
    upper = sum(w[0].isupper() for w in letters)
    shouting = bool(letters) and upper * 10 >= 8 * len(letters)
    words, written, figures = [], [], []
    for place, w in enumerate(raw):
        low = w.lower()
        if w[0].isdigit():
            low = w.replace(",", ".")
            figures.append(low)
        words.append(low)
        written.append(-1 if place == 0 or shouting else int(w[0].isupper()))
    return words, written, sorted(figures)


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for record_id, split, claim in batch.itertuples(index=False):
            words, written, figures = statement_words(claim)
            if not words:
                continue
            seen: Counter = Counter()
            numbered = []
            for w in words:
                seen[w] += 1
                numbered.append(w if seen[w] == 1 else f"{w}\x00{seen[w]}")
            rows.append((record_id, split, numbered, written, " ".join(figures), words[0]))
        yield pd.DataFrame(rows, columns=["record_id", "split", "words", "written", "figures", "first_word"])


def statements(records: DataFrame, key: str = "record_id", split: str = "split", text: str = "claim") -> DataFrame:
    """(record_id, split, words, written, figures, first_word), one row per record with at least one word.

    Repeated words are numbered, so that sets of them compare as multisets."""
    schema = "record_id bigint, split string, words array<string>, written array<int>, figures string, first_word string"
    rows = records.where(F.col(text).isNotNull() & F.col(split).isNotNull()).select(F.col(key).cast("bigint").alias("record_id"), F.col(split).alias("split"), F.col(text).alias("text"))
    return rows.mapInPandas(_tokenise, schema)


def _needed(n: Column) -> Column:
    """ceil(SHARE * n) in integers."""
    return F.floor((n * SHARE_NUMERATOR + (SHARE_DENOMINATOR - 1)) / SHARE_DENOMINATOR).cast("int")


def statement_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (record_id, split, class_id) and one row per class of equal statements: its words, and ``items`` (df,
    code, name_kind, place of the word), rarest first.

    The class id is a 128-bit hash of the sorted words and the first word. A word's code is its 64-bit hash; it stands for
    the word wherever words are looked up or joined (two words of one code would only add a candidate). Statistics are
    over all records: how many classes have the word (its rarity), and whether it is written as a name: never or seldom
    in lower case, and in capitals where capitals tell something. Words of very many classes are looked up by broadcast."""
    words = F.array_join(F.array_sort("words"), "\x01")
    keyed = cut(rows.withColumn("class_id", F.unhex(F.md5(F.concat_ws("\x01", "first_word", words)))))
    members = keyed.select("record_id", "split", "class_id")
    known = F.col("split") == "train"
    single = cut(
        keyed.groupBy("class_id").agg(
            F.bool_or(known).alias("is_train"), F.bool_or(~known).alias("is_eval"), F.first("figures").alias("figures"), F.first("first_word").alias("first_word"), F.first("words").alias("words")
        )
    )
    bare = lambda w: F.xxhash64(F.split_part(w, F.lit("\x00"), F.lit(1)))
    written = keyed.select(F.explode(F.arrays_zip("words", "written")).alias("w"))
    names = written.groupBy(bare(F.col("w.words")).alias("bare")).agg(F.count_if(F.col("w.written") == 1).alias("capital"), F.count_if(F.col("w.written") == 0).alias("lower"))
    name_kind = F.when(F.col("capital") > 2 * F.col("lower"), 2).when((F.col("capital") == 0) & (F.col("lower") == 0), 1).otherwise(0)
    spread = single.select("class_id", F.posexplode("words").alias("at", "word")).select("class_id", "at", F.xxhash64("word").alias("code"), bare(F.col("word")).alias("bare"))
    frequent = spread.groupBy("code", "bare").agg(F.count("*").alias("df"))
    looked_up = cut(frequent.join(names.select("bare", name_kind.cast("tinyint").alias("name_kind")), "bare").drop("bare"))
    found = join_one_sided_hot(spread.drop("bare"), looked_up, ["code"], "inner", "df")
    items = found.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "code", "name_kind", "at"))).alias("items"))
    return members, items.join(single, "class_id").withColumn("n", F.size("items"))


def candidate_classes(classes: DataFrame) -> DataFrame:
    """(eval_class, train_class) pairs that pass the prefix, length, figure and position filters, each once.

    The join key is (word, figures, training length): evaluation prefixes are listed once for every length that the
    length filter allows, so the filter is part of the equi-join and a word shared by very many statements still falls
    apart by figures and length. Equal statements are already one class, so no group of copies is paired here.
    """
    prefix = F.posexplode(F.slice("items.code", F.lit(1), F.col("n") - _needed(F.col("n")) + 1)).alias("place", "code")
    listed = lambda flag, name: classes.where(flag).select(F.col("class_id").alias(name), F.xxhash64("figures").alias("figures"), "n", prefix)
    longest = F.floor(F.col("n") * SHARE_DENOMINATOR / SHARE_NUMERATOR).cast("int")
    evals = listed("is_eval", "eval_class").select(
        "eval_class", "figures", "code", F.col("n").alias("eval_n"), F.col("place").alias("eval_place"), F.explode(F.sequence(_needed(F.col("n")), longest)).alias("n")
    )
    trains = listed("is_train", "train_class")
    most = F.least(F.col("eval_n") - F.col("eval_place"), F.col("n") - F.col("place"))
    return (
        evals.join(trains, ["code", "figures", "n"])
        .where(most + F.least("eval_place", "place") >= _needed(F.greatest("eval_n", "n")))
        .select("eval_class", "train_class")
        .distinct()
    )


def one_slip(a: str, b: str) -> bool:
    """Whether two words are one inserted, dropped or changed letter or one swap of neighbours apart."""
    if a == b or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[i + 1 :] == shorter[i:]


def same_names(only_a: list[tuple[str, int]], only_b: list[tuple[str, int]], first_a: str, first_b: str) -> bool:
    """Whether the words that only one side has are free of names. Each is (word, kind): 2 a name, 1 seen without
    evidence, 0 a common word. A misspelt word is paired off with its right form first. Two different first words
    without evidence count as names."""
    a = [(w.partition("\x00")[0], k) for w, k in only_a]
    b = [(w.partition("\x00")[0], k) for w, k in only_b]
    for x in list(a):
        for y in b:
            if one_slip(x[0], y[0]):
                a.remove(x)
                b.remove(y)
                break
    if any(k == 2 for _, k in a + b):
        return False
    return not ((first_a, 1) in a and (first_b, 1) in b)


def left_over(words: list[str], items: list[dict], other: list[str]) -> list[tuple[str, int]]:
    """(word, kind) of the words that the other side lacks. A Han character of those that write names by sound counts as a
    name where its neighbour is one of them too: names have several, ordinary words seldom."""
    others = set(other)
    named = [w.partition("\x00")[0] in NAME_CHARACTERS for w in words]
    out = []
    for item in items:
        at, kind = item["at"], item["name_kind"]
        if words[at] not in others:
            beside = named[at] and ((at > 0 and named[at - 1]) or (at + 1 < len(words) and named[at + 1]))
            out.append((words[at], 2 if beside else kind))
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            e, t = list(r.eval_words), list(r.train_words)
            shared, longest = len(set(e) & set(t)), max(len(e), len(t))
            if shared * SHARE_DENOMINATOR < longest * SHARE_NUMERATOR or r.eval_figures != r.train_figures:
                continue
            if same_names(left_over(e, r.eval_items, t), left_over(t, r.train_items, e), r.eval_first_word, r.train_first_word):
                rows.append((r.eval_class, r.train_class, shared, longest))
        yield pd.DataFrame(rows, columns=["eval_class", "train_class", "shared", "longest"])


def matching_classes(classes: DataFrame) -> DataFrame:
    """(eval_class, train_class, shared, longest) of all pairs of classes that make the same statement.

    Candidates meet the word codes alone first; only pairs that share enough of them meet the words."""

    def side(name: str, *columns: str) -> DataFrame:
        return classes.select(F.col("class_id").alias(f"{name}_class"), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    coded = classes.select("class_id", F.col("items.code").alias("codes"))
    of = lambda name: coded.select(F.col("class_id").alias(f"{name}_class"), F.col("codes").alias(f"{name}_codes"))
    met = candidate_classes(classes).join(of("eval"), "eval_class").join(of("train"), "train_class")
    enough = F.size(F.array_intersect("eval_codes", "train_codes")) >= _needed(F.greatest(F.size("eval_codes"), F.size("train_codes")))
    near = cut(met.where(enough).select("eval_class", "train_class"))
    columns = ("words", "items", "first_word", "figures")
    both = near.join(side("eval", *columns), "eval_class").join(side("train", *columns), "train_class")
    return both.mapInPandas(_verify, "eval_class binary, train_class binary, shared int, longest int")


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b, eval_id, train_id, eval_split, shared, longest), smaller record id first.

    Splits other than train count as evaluation. Null or wordless claims and null splits give no pairs; a repeated row
    gives its pairs once (ids are made distinct); an empty table gives none; other columns are not read. Word order,
    case, punctuation, accents, white space and digit grouping do not matter. Pairs of copies are listed in full,
    as the result is a list of record pairs; they are only formed at the end, by joining members to matched classes.
    """
    members, classes = statement_classes(statements(records))
    pairs = matching_classes(cut(classes))
    evals = members.where(F.col("split") != "train").select(F.col("class_id").alias("eval_class"), F.col("record_id").alias("eval_id"), F.col("split").alias("eval_split")).distinct()
    trains = members.where(F.col("split") == "train").select(F.col("class_id").alias("train_class"), F.col("record_id").alias("train_id")).distinct()
    return pairs.join(evals, "eval_class").join(trains, "train_class").select(
        F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"),
        "eval_id", "train_id", "eval_split", "shared", "longest",
    )


def overlap_counts(records: DataFrame, by: str) -> DataFrame:
    """(eval_split, by, pairs, eval_records, train_records, equal_pairs) of the same pairs, counted from the sizes of the
    classes: no pair of records is listed. ``by`` is a column of ``records``; record ids are taken as unique."""
    members, classes = statement_classes(statements(records))
    matched = cut(matching_classes(cut(classes)))
    sources = records.select(F.col("record_id").cast("bigint").alias("record_id"), by).distinct()
    evals = members.where(F.col("split") != "train").distinct().join(sources, "record_id").groupBy(F.col("class_id").alias("eval_class"), F.col("split").alias("eval_split"), by).agg(F.count("*").alias("n_eval"))
    trains = members.where(F.col("split") == "train").distinct().groupBy(F.col("class_id").alias("train_class")).agg(F.count("*").alias("n_train"))
    met = matched.join(evals, "eval_class").join(trains, "train_class")
    pairs = F.col("n_eval") * F.col("n_train")
    group = ["eval_split", by]
    sums = met.groupBy(*group).agg(F.sum(pairs).alias("pairs"), F.sum(F.when(F.col("shared") == F.col("longest"), pairs).otherwise(0)).alias("equal_pairs"))
    of_evals = met.select(*group, "eval_class", "n_eval").distinct().groupBy(*group).agg(F.sum("n_eval").alias("eval_records"))
    of_trains = met.select(*group, "train_class", "n_train").distinct().groupBy(*group).agg(F.sum("n_train").alias("train_records"))
    same = lambda other: F.col("s.eval_split").eqNullSafe(F.col(f"{other}.eval_split")) & F.col(f"s.{by}").eqNullSafe(F.col(f"{other}.{by}"))
    joined = sums.alias("s").join(of_evals.alias("e"), same("e")).join(of_trains.alias("t"), same("t"))
    return joined.select("s.eval_split", f"s.{by}", "pairs", "eval_records", "train_records", "equal_pairs")
