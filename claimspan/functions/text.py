"""Column expressions over text: tokens, sentences, claim features. All stay in the JVM; a null text gives empty or null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

_EMPTY = "array<string>"
_WORD_RUN = r"[\p{L}\p{N}_]+"


def words_in(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def empty() -> Column:
    return F.array().cast(_EMPTY)


def ascii_words(text: Column) -> Column:
    """Whole words of ASCII letters and digits, in order, lower case: a word that also has other letters is none."""
    runs = F.regexp_extract_all(text, F.lit(_WORD_RUN), F.lit(0))
    return F.coalesce(F.transform(F.filter(runs, lambda w: w.rlike("^[a-zA-Z0-9]+$")), F.lower), empty())


def token_set(text: Column, stopwords: Iterable[str] = V.STOPWORDS_BLOCKING) -> Column:
    """Distinct words without stop words, in order of first occurrence."""
    return F.array_except(ascii_words(text), words_in(stopwords))


def token_list(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, repeats kept (index and overlap tokeniser)."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), empty())


def blank_split(text: Column) -> Column:
    """Pieces between white space of the lower-cased text, punctuation kept (inference tokeniser)."""
    return F.filter(F.coalesce(F.split(F.lower(text), r"[\s  - 　]+"), empty()), lambda w: w != "")


def apostrophe_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), empty())


def relevance_keywords(text: Column) -> Column:
    """Distinct lower-case words of three letters or more without stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_WORD_RUN), F.lit(0))
    return F.array_except(F.coalesce(F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$")), empty()), words_in(V.STOPWORDS_RELEVANCE))


def content_tokens(text: Column) -> Column:
    """Distinct words of four letters or more without stop words, each with its stems (e, ed, ing, es, s taken off)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0))
    kept = F.array_distinct(F.filter(F.coalesce(words, empty()), lambda w: (F.length(w) >= 4) & ~w.isin(*V.CONTENT_STOPWORDS)))

    def stems(w: Column) -> Column:
        cut = lambda ending, longer: F.when(w.endswith(ending) & (F.length(w) > longer), F.substring(w, F.lit(1), F.length(w) - len(ending)))
        return F.array_compact(F.array(w, cut("e", 4), cut("ed", 5), cut("ing", 6), cut("es", 5), cut("s", 4)))

    return F.array_distinct(F.flatten(F.transform(kept, stems)))


def size_of_common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 when a side is empty."""
    common = size_of_common(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def coverage(query: Column, other: Column) -> Column:
    """Share of the query's tokens found on the other side; 0 when the query has none."""
    return F.when(F.size(query) == 0, 0.0).otherwise(size_of_common(query, other) / F.size(query))


def lexical_relevance(query: Column, other: Column) -> Column:
    return 0.6 * coverage(query, other) + 0.4 * jaccard(query, other)


def multiset_overlap(query: Column, other: Column) -> Column:
    """Sum over the query's tokens of the lesser count, over the query's length; 0 when a side is empty."""
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(query), F.lit(0), lambda acc, t: acc + F.least(count(query, t), count(other, t)))
    return F.when((F.size(query) == 0) | (F.size(other) == 0), 0.0).otherwise(shared / F.size(query))


def _pieces(text: Column, pattern: str) -> Column:
    split = F.coalesce(F.split(text, pattern), empty())
    return F.filter(F.transform(split, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences_plain(text: Column) -> Column:
    """Split after . ! ? and white space, and at line breaks; trimmed, empty ones dropped."""
    return _pieces(text, r"(?<=[.!?])\s+|\n+")


def sentences_protected(text: Column) -> Column:
    """The same, with ten common abbreviations that end nothing."""
    guarded = text
    for a in V.ABBREVIATIONS:
        guarded = F.replace(guarded, F.lit(a), F.lit(a.replace(".", "<DOT>")))
    return F.transform(sentences_plain(guarded), lambda s: F.replace(s, F.lit("<DOT>"), F.lit(".")))


def first_sentences(text: Column, n: int) -> Column:
    """The first n sentences after white space was collapsed, joined by spaces (stance input)."""
    collapsed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.array_join(F.slice(F.split(collapsed, r"(?<=[.!?])\s+"), 1, n), " ")


def collapse_white_space(text: Column) -> Column:
    """Spaces and tabs to one space, at most one empty line, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def decode_markup(text: Column) -> Column:
    out = F.replace(text, F.lit("_"), F.lit(" "))
    for old, new in V.MARKUP:
        out = F.replace(out, F.lit(old), F.lit(new))
    return collapse_white_space(out)


def wiki_url(title: Column) -> Column:
    """Encyclopedia address of a title; a few marks stay as they are and spaces become underscores."""
    slug = F.replace(F.replace(F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), slug)


def parse_time(value: Column) -> Column:
    """Timestamp of an ISO-like text, or of its date part; null if neither reads."""
    clean = F.trim(value)
    return F.coalesce(F.try_to_timestamp(clean), F.try_to_timestamp(F.split_part(clean, F.lit("T"), F.lit(1))))


def entities(text: Column) -> Column:
    """Capitalised words of two characters or more, distinct and sorted."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z0-9_-]+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_sort(F.array_except(F.coalesce(runs, empty()), words_in(V.ENTITY_STOPWORDS)))


def first_time(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){V.TIME_PATTERN}", 0), F.lit(""))


def _letter_words(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(_WORD_RUN), F.lit(0))
    return F.coalesce(F.transform(F.filter(runs, lambda w: w.rlike("^[a-zA-Z]+$")), F.lower), empty())


def polarity(text: Column) -> Column:
    """negative before uncertain before positive."""
    words = _letter_words(text)
    return (
        F.when(F.arrays_overlap(words, words_in(V.NEGATIVE_HINTS)), "negative")
        .when(F.arrays_overlap(words, words_in(V.UNCERTAIN_HINTS)), "uncertain")
        .otherwise("positive")
    )


def certainty(text: Column) -> Column:
    """Here uncertain words win over negative ones."""
    words = _letter_words(text)
    return (
        F.when(F.arrays_overlap(words, words_in(V.UNCERTAIN_HINTS)), 0.45)
        .when(F.arrays_overlap(words, words_in(V.NEGATIVE_HINTS)), 0.7)
        .otherwise(0.85)
    )


def is_question(text: Column) -> Column:
    """Ends with ? after a question word first, or begins with why."""
    first = F.regexp_extract(F.lower(text), "[a-z]+", 0)
    return F.coalesce(F.when(first == "", False).when(F.trim(text).endswith("?"), first.isin(*V.QUESTION_PREFIXES)).otherwise(first == "why"), F.lit(False))


def keyword_label(text: Column) -> Column:
    """refuting words before supporting ones; else not enough."""
    words = apostrophe_words(text)
    return (
        F.when(F.arrays_overlap(words, words_in(V.KEYWORDS_REFUTE)), "contradiction")
        .when(F.arrays_overlap(words, words_in(V.KEYWORDS_SUPPORT)), "entailment")
        .otherwise("neutral")
    )


def scored_label(raw: Column) -> Column:
    """Label in scoring vocabulary: aliases mapped, abstentions null, anything else as it is in lower case."""
    low = F.lower(F.trim(raw))
    out = F.when(low.isin(*V.LABEL_ALIASES[None]), F.lit(None).cast("string"))
    for label in V.NLI_LABELS:
        out = out.when(low.isin(*V.LABEL_ALIASES[label]), label)
    return out.otherwise(low)


def answer_sentence(question: Column, answer: Column) -> Column:
    """The sentence a short answer stands for, from the first of eleven question forms that fits."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(answer, r"\s+", " ")), r"\.+$", "")
    asked = F.regexp_replace(F.trim(F.regexp_replace(question, r"\s+", " ")), r"\?+$", "")
    said: Column | None = None
    for pattern, sentence in V.ANSWER_SENTENCES:
        subject = F.trim(F.regexp_extract(asked, f"(?i)^{pattern}$", 1))
        parts = sentence.replace("{subject}", "\0s\0").replace("{answer}", "\0a\0").split("\0")
        built = F.concat(*(subject if p == "s" else clean if p == "a" else F.lit(p) for p in parts if p))
        said = F.when(asked.rlike(f"(?i)^{pattern}$"), built) if said is None else said.when(asked.rlike(f"(?i)^{pattern}$"), built)
    said = said.otherwise(F.concat(F.lit("The answer to "), asked, F.lit(" is "), clean, F.lit(".")))
    usable = (clean != "") & ~F.lower(F.trim(answer)).isin(*V.NO_ANSWER) & (asked != "")
    return F.when(usable, said)


def word_set(text: Column) -> Column:
    """Distinct words of letters, figures and underscores, lower case."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_WORD_RUN), F.lit(0)), empty()))


def first_tokens(text: Column, n: int) -> Column:
    """The first n pieces between white space, joined by spaces; a null text is empty."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def model_input(claim: Column, evidence: Column, n: int = 256) -> Column:
    """Claim and evidence as one input of a pair model, evidence cut to n tokens."""
    return F.concat(F.trim(F.coalesce(claim, F.lit(""))), F.lit(" [SEP] "), first_tokens(evidence, n))


def without_negation(text: Column) -> Column:
    """The text without its negating words, in the order of the rest."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), "[^a-z']", "")
    return F.array_join(F.filter(words, lambda w: ~bare(w).isin(*V.KEYWORDS_REFUTE)), " ")


def json_object(text: Column) -> Column:
    """What lies between the first { and the last } of a text, brackets included; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the parts as a JSON object with sorted names; null parts are left out of it."""
    return F.sha2(F.to_json(F.struct(*(parts[name].alias(name) for name in sorted(parts)))), 256)
