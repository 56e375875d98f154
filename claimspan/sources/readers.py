"""Readers and writers. Every reader returns a lazy DataFrame; malformed records are told apart, not dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import nested_json as nj

ANSWER = "struct<answer: string, answer_type: string, source_url: string, source_medium: string, cached_source_url: string>"
QUESTIONS = f"array<struct<question: string, answers: array<{ANSWER}>>>"
RETRIEVAL = (
    "sample_id string, query string, label string, metadata map<string, string>, retrieved_chunks array<struct<chunk_id: string, text: string, rank: int, retrieval_score: double,"
    " source_url: string, source_medium: string, metadata: map<string, string>>>"
)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a leading byte order mark ignored; lines that do not parse have
    ``_corrupt`` set and nulls elsewhere."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("line")).where(F.trim("line") != "")
    parsed = lines.select("line", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, node rows): whole files holding one record, an array, or an array under data, records or examples."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return nj.flatten_records(files.select(F.xxhash64("file").alias("record_id"), F.col("value").alias("body")))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval records of any of the accepted file shapes."""
    records = read_json_documents(spark, path).where("node_kind = 'record'")
    return records.select(F.from_json("value", RETRIEVAL).alias("r")).select("r.*")


def read_pairs_csv(spark: SparkSession, bodies: str, stances: str, keep_missing: bool = True) -> DataFrame:
    """(sample_id, headline, body_id, body, stance_label, nli_label): stances joined with bodies by id.

    With ``keep_missing`` a stance without body has an empty body, else it is left out. Body ids must be unique; repeated
    ones raise an error when the result is computed."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    b = spark.read.csv(bodies, **options).select(F.col("Body ID").alias("body_id"), F.col("articleBody").alias("body"))
    unique = b.groupBy("body_id").agg(F.count("*").alias("n"), F.first("body").alias("body"))
    checked = unique.select("body_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated body id "), "body_id"))).otherwise(F.col("body")).alias("body"))
    s = spark.read.csv(stances, **options).select(F.col("Headline").alias("headline"), F.col("Body ID").alias("body_id"), F.lower(F.trim("Stance")).alias("stance_label"))
    joined = s.join(checked, "body_id", "left" if keep_missing else "inner")
    return joined.select(
        F.sha1(F.concat_ws("\x01", "headline", "body_id")).alias("sample_id"), "headline", "body_id", F.coalesce("body", F.lit("")).alias("body"), "stance_label",
        mapped(F.col("stance_label"), V.STANCE_TO_NLI, "neutral").alias("nli_label"),
    )


def mapped(value: Column, table: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), F.lit(otherwise))


def corpus_records(raw: DataFrame) -> DataFrame:
    """Document records from loosely named columns: id from doc_id, id or title, text from full_text, text or content.

    Records without id or text are left out; columns that are not known become entries of ``metadata`` as text."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(have[n]).cast("string")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    known = ("doc_id", "id", "title", "full_text", "text", "content", "dataset", "source_name", "source_url", "published_at", "language", "metadata")
    rest = [c for low, c in have.items() if low not in known]
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest)), lambda e: e["value"].isNotNull()) if rest else None
    metadata = F.map_from_entries(entries) if rest else F.create_map().cast("map<string,string>")
    out = raw.select(
        pick("doc_id", "id", "title").alias("doc_id"), F.coalesce(pick("dataset"), F.lit("generic")).alias("dataset"), pick("source_name").alias("source_name"), pick("source_url").alias("source_url"),
        T.decode_markup(pick("title")).alias("title"), pick("published_at").alias("published_at"), pick("language").alias("language"),
        T.collapse_white_space(pick("full_text", "text", "content")).alias("full_text"), metadata.alias("metadata"),
    )
    return out.where("doc_id is not null and full_text is not null")


def encyclopedia_records(raw: DataFrame) -> DataFrame:
    """The same for encyclopedia pages: a source name and an address made from the title where they are missing."""
    records = corpus_records(raw)
    return records.withColumn("source_name", F.coalesce("source_name", F.lit("Wikipedia"))).withColumn("source_url", F.coalesce("source_url", T.wiki_url(F.col("title"))))


def evidence_titles(evidence: Column) -> Column:
    """Distinct titles, in order, of evidence sets: lists of lists whose third item is a page title."""
    flat = F.flatten(evidence)
    named = F.transform(F.filter(flat, lambda e: F.size(e) >= 3), lambda e: F.element_at(e, 3))
    return F.array_distinct(F.filter(named, lambda t: t.isNotNull() & (t != "")))


def answer_documents(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Documents from questions with answers: (doc_id, source_url, source_medium, full_text), and one per justification.

    Answers that say nothing was found are left out, as are empty ones."""
    rows = records.select(key, F.posexplode("questions").alias("q_no", "q")).select(key, "q_no", "q.question", F.posexplode("q.answers").alias("a_no", "a"))
    text = F.trim(F.coalesce("a.answer", F.lit("")))
    useful = rows.where((text != "") & ~F.lower(text).contains("no answer could be found") & ~F.lower(text).contains("no answer was found"))
    answers = useful.select(
        F.concat(F.col(key).cast("string"), F.lit(":q"), "q_no", F.lit(":a"), "a_no").alias("doc_id"), F.col("a.source_url").alias("source_url"), F.col("a.source_medium").alias("source_medium"),
        F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), text).alias("full_text"),
    )
    why = records.where(F.trim(F.coalesce("justification", F.lit(""))) != "")
    return answers.unionByName(
        why.select(F.concat(F.col(key).cast("string"), F.lit(":justification")).alias("doc_id"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("source_medium"), F.trim("justification").alias("full_text"))
    )


def answers_as_chunks(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Records as retrieval input: (sample_id, query, label, chunk_id, text, rank, retrieval_score); the rank runs over the
    non-empty answers in order, the score is its inverse to four places."""
    from pyspark.sql import Window

    rows = records.select(key, "claim", "label", F.posexplode("questions").alias("q_no", "q")).select(key, "claim", "label", "q_no", F.posexplode("q.answers").alias("a_no", "a"))
    filled = rows.where(F.trim(F.coalesce("a.answer", F.lit(""))) != "")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("q_no", "a_no"))
    return filled.withColumn("rank", rank).select(
        F.col(key).cast("string").alias("sample_id"), F.col("claim").alias("query"), mapped(F.col("label"), V.VERDICT_TO_NLI, "neutral").alias("label"),
        F.concat(F.col(key).cast("string"), F.lit(":q"), "q_no", F.lit(":a"), "a_no").alias("chunk_id"), F.col("a.answer").alias("text"), "rank", F.round(1 / F.col("rank"), 4).alias("retrieval_score"),
    )


def validate_payloads(payloads: DataFrame, key: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rejects have ``faults``: no_sample, null_claim_id, repeated_claim_id, null_pair_id."""
    ids = F.transform(F.coalesce("claims", F.array().cast(payloads.schema["claims"].dataType)), lambda c: c["claim_id"])
    loose = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast(payloads.schema[c].dataType)), lambda p: p["claim_a_id"].isNull() | p["claim_b_id"].isNull())
    known = F.filter(ids, lambda i: i.isNotNull())
    faults = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("sample_id", F.lit(""))) == "", "no_sample"),
            F.when(F.exists(ids, lambda i: i.isNull()), "null_claim_id"),
            F.when(F.size(F.array_distinct(known)) < F.size(known), "repeated_claim_id"),
            F.when(loose("candidate_pairs") | loose("nli_results"), "null_pair_id"),
        )
    )
    judged = payloads.withColumn("faults", faults)
    return judged.where(F.size("faults") == 0).drop("faults"), judged.where(F.size("faults") > 0).select(key, "sample_id", "faults")


def payload_records(claims: DataFrame, pairs: DataFrame, results: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Nested export records (sample, claims, candidate_pairs, nli_results), each list in its order."""

    def listed(rows: DataFrame, order: str, name: str) -> DataFrame:
        fields = F.struct(order, F.struct(*(c for c in rows.columns if c not in (sample, order))).alias("x"))
        return rows.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda s: s["x"]).alias(name))

    return listed(claims, "ord", "claims").join(listed(pairs, "ord", "candidate_pairs"), sample, "left").join(listed(results, "ord", "nli_results"), sample, "left")


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def artifact_status(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(artifact, rows, status): ready, empty or missing, for tables of a folder."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    out = None
    for name in names:
        try:
            part = spark.read.parquet(f"{folder}/{name}.parquet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("artifact"), "rows")
        except (PySparkException, Py4JError):
            part = spark.range(1).select(F.lit(name).alias("artifact"), F.lit(None).cast("bigint").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").otherwise("ready"))
