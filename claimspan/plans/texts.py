"""Queries over tokens, sentences and other text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import retrieval as R
from ..runtime import spread, table
from . import sql as S


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "averitec").select("record_id", F.posexplode("questions").alias("q_no", "q"))
    return q.select("record_id", "q_no", "q.question", F.posexplode("q.answers").alias("a_no", "a")).select("record_id", "q_no", "a_no", "question", "a.answer", "a.answer_type", "a.source_url", "a.source_medium")


def tok_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the token sets of the three lexical tokenisers and of the token list, per document."""
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.size(T.token_set(t)).alias("blocking"), F.size(T.token_set(t, V.STOPWORDS_EVIDENCE)).alias("evidence"),
        F.size(T.token_set(t, V.STOPWORDS_HEADLINE)).alias("headline"), F.size(T.token_list(t)).alias("listed"), F.size(T.apostrophe_words(t)).alias("apostrophe"),
    )


def token_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Document and total frequency of every index token."""
    return R.token_frequencies(spread(table(spark, folder, "documents").select("text")).select(T.token_list(F.col("text")).alias("tokens")))


def top_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The 80 most frequent tokens of the justifications, ties by token."""
    tokens = table(spark, folder, "averitec").select(F.explode(T.token_list(F.col("justification"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "token").limit(80)


def sentences_t2(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences_plain(F.col("text"))).alias("sent_no", "sentence"))


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Claim against its justification."""
    a, b = T.token_set(F.col("claim")), T.token_set(F.col("justification"))
    return table(spark, folder, "averitec").select("record_id", T.jaccard(a, b).alias("jaccard"), T.coverage(a, b).alias("coverage"))


def question_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).where(T.is_question(F.col("question"))).select("record_id", "q_no", "a_no")


def polarity_certainty(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("claim")
    return table(spark, folder, "averitec").select("record_id", T.polarity(t).alias("polarity"), T.certainty(t).alias("certainty"))


def entities_regex(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "averitec").select("record_id", F.array_join(T.entities(F.col("claim")), "|").alias("entities"))


def keyword_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "averitec").select("record_id", T.keyword_label(F.col("claim")).alias("label"))


def answer_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("record_id", "q_no", "a_no", T.answer_sentence(F.col("question"), F.col("answer")).alias("sentence"))


def time_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "averitec").select("record_id", T.first_time(F.col("claim")).alias("time"))


def markup_decode(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "retrieval_json").select("row_id", F.posexplode("retrieved_chunks.text").alias("at", "text"))
    return chunks.select("row_id", "at", T.decode_markup(F.col("text")).alias("text"))


def source_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Medium and host of the sources named in answers."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("source_url", F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return _answers(spark, folder).groupBy(F.lower("source_medium").alias("medium"), host.alias("host")).agg(F.count("*").alias("answers"))


QUERIES = {
    f.__name__: f
    for f in (tok_sets, token_frequencies, top_tokens, sentences_t2, jaccard_pairs, question_filter, polarity_certainty, entities_regex, keyword_labels, answer_sentences, time_extract, markup_decode, source_frequencies)
}

ANSWERS = """answers as (
  select record_id, q_no, a_no, question, a.answer as answer, a.answer_type as answer_type, a.source_url as source_url, a.source_medium as source_medium from (
    select record_id, q_no, q.question as question, unnest(q.answers) as a, unnest(range(len(q.answers)))::int as a_no from (
      select record_id, unnest(questions) as q, unnest(range(len(questions)))::int as q_no from averitec)))"""
_A, _B = S.token_set("claim"), S.token_set("justification")
_FIRST = "regexp_extract(lower(question), '[a-z]+')"


def _answer_sentence_sql() -> str:
    clean = r"regexp_replace(trim(regexp_replace(answer, '\s+', ' ', 'g')), '\.+$', '')"
    asked = r"regexp_replace(trim(regexp_replace(question, '\s+', ' ', 'g')), '\?+$', '')"
    cases = []
    for pattern, sentence in V.ANSWER_SENTENCES:
        built = "'" + sentence.replace("{subject}", f"' || trim(regexp_extract(asked, '(?i)^{pattern}$', 1)) || '").replace("{answer}", "' || clean || '") + "'"
        cases.append(f"when regexp_matches(asked, '(?i)^{pattern}$') then {built}")
    usable = f"clean <> '' and not list_contains({S.strings(V.NO_ANSWER)}, lower(trim(answer))) and asked <> ''"
    return f"""with {ANSWERS}, c as (select *, {clean} as clean, {asked} as asked from answers)
        select record_id, q_no, a_no, case when {usable} then case {' '.join(cases)} else 'The answer to ' || asked || ' is ' || clean || '.' end end as sentence from c"""


def _decoded_sql(text: str) -> str:
    out = f"replace({text}, '_', ' ')"
    for old, new in V.MARKUP:
        out = "replace({}, '{}', '{}')".format(out, old.replace("'", "''"), new.replace("'", "''"))
    return out


ORACLES = {
    "tok_sets": f"""select doc_id, len({S.token_set("text")})::int as blocking, len({S.token_set("text", V.STOPWORDS_EVIDENCE)})::int as evidence,
        len({S.token_set("text", V.STOPWORDS_HEADLINE)})::int as headline, len({S.token_list("text")})::int as listed,
        len(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'))::int as apostrophe from documents""",
    "token_frequencies": f"""select token, count(*) as df, sum(tf)::bigint as total from (
        select token, doc_id, count(*) as tf from (select doc_id, unnest({S.token_list("text")}) as token from documents) group by all) group by all""",
    "top_tokens": f"select token, count(*) as times from (select unnest({S.token_list('justification')}) as token from averitec) group by token order by times desc, token limit 80",
    "sentences_t2": f"""select doc_id, sent_no, sentence from (
        select doc_id, unnest({S.sentences_plain("text")}) as sentence, unnest(range(len({S.sentences_plain("text")})))::int as sent_no from documents)""",
    "jaccard_pairs": f"select record_id, {S.jaccard(_A, _B)} as jaccard, {S.coverage(_A, _B)} as coverage from averitec",
    "question_filter": f"""with {ANSWERS} select record_id, q_no, a_no from answers where {_FIRST} <> ''
        and case when trim(question) like '%?' then list_contains({S.strings(V.QUESTION_PREFIXES)}, {_FIRST}) else {_FIRST} = 'why' end""",
    "polarity_certainty": f"""select record_id, {S.polarity("claim")} as polarity,
        case when {S.has(S.letter_words("claim"), V.UNCERTAIN_HINTS)} then 0.45 when {S.has(S.letter_words("claim"), V.NEGATIVE_HINTS)} then 0.7 else 0.85 end::double as certainty from averitec""",
    "markup_decode": rf"""with c as (select row_id, i::int as "at", c.text as text from (select row_id, unnest(retrieved_chunks) as c, unnest(range(len(retrieved_chunks))) as i from retrieval_json)),
        d as (select row_id, "at", {_decoded_sql("text")} as t from c)
        select row_id, "at", trim(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) as text from d""",
    "time_extract": rf"""select record_id, nullif(regexp_extract(claim, '(?i)(?:^|[^\p{{L}}\p{{N}}_])({V.TIME_PATTERN.removeprefix(chr(92) + "b").removesuffix(chr(92) + "b")})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') as time from averitec""",
    "keyword_labels": f"""select record_id, case when list_has_any(w, {S.strings(V.KEYWORDS_REFUTE)}) then 'contradiction'
        when list_has_any(w, {S.strings(V.KEYWORDS_SUPPORT)}) then 'entailment' else 'neutral' end as label
        from (select record_id, regexp_extract_all(lower(claim), '[a-z'']+') as w from averitec)""",
    "answer_sentences": _answer_sentence_sql(),
    "source_frequencies": rf"""with {ANSWERS} select lower(source_medium) as medium,
        coalesce(regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/?#]+)', 1), '^www\.', ''), '') as host, count(*) as answers from answers group by all""",
}
