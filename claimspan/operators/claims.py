"""Claims from retrieved text, candidate pairs and inference labels. A sample is one query with its retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..runtime import computed
from .retrieval import hash_vectors


def chunk_inputs(retrieval: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, chunk_ord, chunk_id, role, text): the query as chunk 0, then the retrieved chunks with text.

    A missing chunk id becomes retrieved-i, counted before blank chunks are dropped."""
    chunks = F.transform(
        F.coalesce(F.col("retrieved_chunks"), F.array()),
        lambda c, i: F.struct((i + 1).alias("chunk_ord"), F.coalesce(c["chunk_id"], F.concat(F.lit("retrieved-"), i + 1)).alias("chunk_id"), F.lit("retrieved_evidence").alias("role"), c["text"].alias("text")),
    )
    asked = F.array(F.struct(F.lit(0).alias("chunk_ord"), F.lit("query").alias("chunk_id"), F.lit("query").alias("role"), F.col("query").alias("text")))
    rows = retrieval.select(sample, F.explode(F.concat(asked, chunks)).alias("c")).select(sample, "c.*")
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def sentence_claims(chunks: DataFrame, sample: str = "sample_id", least: int = 15) -> DataFrame:
    """(sample, chunk_ord, sent_no, claim_id, role, text, entities, subject, time, polarity, certainty).

    One claim per sentence of ``least`` characters; questions only from the query. The sentence number counts before
    anything is dropped, so ids have gaps."""
    sentences = chunks.select(sample, "chunk_ord", "chunk_id", "role", F.posexplode(T.sentences_protected(F.col("text"))).alias("sent_no", "text"))
    kept = sentences.where((F.length("text") >= least) & ((F.col("role") == "query") | ~T.is_question(F.col("text"))))
    named = computed(kept, entities=T.entities(F.col("text")))
    return named.select(
        sample, "chunk_ord", "sent_no", F.concat(F.col(sample).cast("string"), F.lit(":"), "chunk_id", F.lit(":sent"), "sent_no").alias("claim_id"), "role", "text", "entities",
        F.try_element_at("entities", F.lit(1)).alias("subject"), T.first_time(F.col("text")).alias("time"), T.polarity(F.col("text")).alias("polarity"), T.certainty(F.col("text")).alias("certainty"),
    )


def candidate_pairs(
    claims: DataFrame,
    sample: str = "sample_id",
    mode: str = "cascade",
    least_entities: int = 1,
    least_lexical: float = 0.1,
    query_lexical: float | None = None,
    allow_empty_entities: bool = True,
    least_embedding: float | None = None,
    indexed: bool = False,
) -> DataFrame:
    """Pairs of claims of one sample: (sample, ord_a, ord_b, claim_a_id, claim_b_id, text_a, text_b, role_a, role_b,
    entity_overlap, lexical), and embedding if ``least_embedding`` is set.

    ``claims`` has (sample, ord, claim_id, text, role, entities). Three stages: shared entities (pairs without entities
    on a side pass if allowed), lexical similarity, and the cosine of the texts' hash vectors, which every pair passes
    where no ``least_embedding`` is set. cascade wants all three, union lexical similarity and one of the other two; so
    union always contains cascade, and without ``least_embedding`` it is the lexical stage alone. Tokens and vectors are
    computed once a claim. The cosine, to six places, is computed for pairs that pass the lexical stage.

    All pairs of a sample are formed on the sample key, which suits samples of one query and a few chunks; with
    ``indexed`` pairs are found through the index of ``shared_tokens`` instead, which suits samples of many claims (and a
    whole corpus as one sample). Both give the same pairs; the index needs a lexical threshold above 0."""
    if mode not in ("cascade", "union"):
        raise ValueError(f"unknown mode {mode!r}")
    base = computed(claims.select(sample, "ord", "claim_id", "text", "role", F.coalesce("entities", F.array().cast("array<string>")).alias("entities")), tokens=T.token_set(F.col("text")))
    columns = ["ord", "claim_id", "text", "role", "entities", "tokens"]
    if least_embedding is not None:
        # The claim is the key, so that no join is needed to bring the vectors back.
        base = hash_vectors(base.select(F.struct(sample, *columns).alias("claim"), "text"), key="claim").select("claim.*", "vector")
        columns = [*columns, "vector"]
    side = lambda x: base.select(sample, *(F.col(c).alias(f"{c}_{x}") for c in columns))
    if indexed:
        least = least_lexical if query_lexical is None else min(least_lexical, query_lexical)
        pairs = shared_tokens(base, sample, least).join(side("a").hint("merge"), [sample, "ord_a"]).join(side("b").hint("merge"), [sample, "ord_b"])
    else:
        pairs = side("a").join(side("b"), sample).where("ord_a < ord_b")
    scored = pairs.withColumn("lexical", T.jaccard(F.col("tokens_a"), F.col("tokens_b"))).withColumn("entity_overlap", T.size_of_common(F.col("entities_a"), F.col("entities_b")))
    crossing = F.array_sort(F.array(F.lower(F.trim("role_a")), F.lower(F.trim("role_b")))) == F.array(F.lit("query"), F.lit("retrieved_evidence"))
    floor = F.lit(least_lexical) if query_lexical is None else F.when(F.coalesce(crossing, F.lit(False)), query_lexical).otherwise(least_lexical)
    both = (F.size("entities_a") > 0) & (F.size("entities_b") > 0)
    entity_ok = F.when(both, F.col("entity_overlap") >= least_entities).otherwise(F.lit(allow_empty_entities))
    lexical_ok = F.col("lexical") >= floor
    out = [sample, "ord_a", "ord_b", "claim_id_a", "claim_id_b", "text_a", "text_b", "role_a", "role_b", "entity_overlap", "lexical"]
    near, embedding_ok = scored.where(lexical_ok), F.lit(True)
    if least_embedding is not None:
        dot = F.aggregate(F.zip_with("vector_a", "vector_b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)
        near, embedding_ok, out = computed(near, embedding=F.round(dot, 6)), F.col("embedding") >= least_embedding, [*out, "embedding"]
    return near.where(entity_ok & embedding_ok if mode == "cascade" else entity_ok | embedding_ok).select(*out)


def shared_tokens(claims: DataFrame, sample: str, least: float) -> DataFrame:
    """(sample, ord_a, ord_b), each once: claims of one sample whose tokens may have a Jaccard similarity of ``least``.

    Two sets of n and m tokens with similarity t share ceil(t * n) of the first, so with any common order of tokens
    their first n - ceil(t * n) + 1 and m - ceil(t * m) + 1 have one in common. Rarest first, so frequent tokens seldom
    stand in front; the lengths must allow the similarity too. ``claims``: (sample, ord, tokens), ord unique.

    The joins are merge joins by hint: an exploded list counts as one row in the planner's estimate, so it would broadcast
    tables of the whole corpus' words through the driver."""
    if not 0 < least <= 1:
        raise ValueError("the index needs a lexical threshold above 0")
    words = claims.select(sample, "ord", F.explode("tokens").alias("token"))
    frequency = words.groupBy(sample, "token").agg(F.count("*").alias("df"))
    ordered = words.join(frequency.hint("merge"), [sample, "token"]).groupBy(sample, "ord").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("items"))
    n = F.size("items")
    front = F.slice("items", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)
    listed = ordered.select(sample, "ord", n.alias("n"), F.explode(front).alias("item")).select(sample, "ord", "n", F.col("item.token").alias("token"))
    side = lambda x: listed.select(sample, "token", F.col("ord").alias(f"ord_{x}"), F.col("n").alias(f"n_{x}"))
    met = side("a").join(side("b").hint("merge"), [sample, "token"]).where((F.col("ord_a") < F.col("ord_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9))
    return met.select(sample, "ord_a", "ord_b").distinct()


def heuristic_scores(text_a: Column, text_b: Column, lexical: Column) -> Column:
    """struct<entailment, contradiction, neutral> by the first rule that holds. All rules are symmetric, so the mean over
    both directions is the same."""
    a, b = T.blank_split(text_a), T.blank_split(text_b)
    has = lambda words, hints: F.arrays_overlap(words, T.words_in(hints))
    supported = F.lit(False)
    for x, y in V.SUPPORTED_NEGATION:
        for p, q in ((a, b), (b, a)):
            supported = supported | (F.array_contains(p, x) & F.array_contains(q, y))
    score = lambda e, c, n: F.struct(F.lit(e).alias("entailment"), F.lit(c).alias("contradiction"), F.lit(n).alias("neutral"))
    return (
        F.when((lexical >= 0.18) & supported, score(0.76, 0.12, 0.12))
        .when((lexical >= 0.22) & (has(a, V.REFUTATION_HINTS) != has(b, V.REFUTATION_HINTS)), score(0.08, 0.78, 0.14))
        .when((lexical >= 0.3) & (has(a, V.NEGATION_HINTS) != has(b, V.NEGATION_HINTS)), score(0.08, 0.82, 0.1))
        .when(lexical >= 0.4, score(0.82, 0.08, 0.1))
        .otherwise(score(0.1, 0.1, 0.8))
    )


def top_label(scores: Column) -> Column:
    """Label of the largest score; ties in the order entailment, contradiction, neutral."""
    e, c, n = scores["entailment"], scores["contradiction"], scores["neutral"]
    return F.when((e >= c) & (e >= n), "entailment").when(c >= n, "contradiction").otherwise("neutral")


def label_pairs(pairs: DataFrame) -> DataFrame:
    scored = computed(pairs, scores=heuristic_scores(F.col("text_a"), F.col("text_b"), F.col("lexical")))
    return scored.withColumn("label", top_label(F.col("scores")))


def _normalised(scores: Column) -> Column:
    parts = [F.greatest(scores[x], F.lit(0.0)) for x in V.NLI_LABELS]
    total = parts[0] + parts[1] + parts[2]
    return F.struct(*(F.when(total > 0, p / total).otherwise(1 / 3).alias(x) for p, x in zip(parts, V.NLI_LABELS, strict=True)))


def ensemble(rows: DataFrame, scores: list[str], weights: list[float], out: str = "scores") -> DataFrame:
    """Adds the weighted mean of normalised scores, normalised again; all-zero scores count as one third each."""
    parts = computed(rows, **{f"_part{i}": _normalised(F.col(s)) for i, s in enumerate(scores)})
    mean = F.struct(*(sum((w * F.col(f"_part{i}.{x}") for i, w in enumerate(weights)), F.lit(0.0)).alias(x) for x in V.NLI_LABELS))
    mixed = computed(parts, _mean=mean).drop(*(f"_part{i}" for i in range(len(scores))))
    return mixed.withColumn(out, _normalised(F.col("_mean"))).drop("_mean")


def with_temperature(rows: DataFrame, temperature: Column, scores: str = "scores", out: str = "scores") -> DataFrame:
    """Softmax of log scores over the temperature, to six places; 1 leaves them as they are."""
    parts = computed(rows, _part=_normalised(F.col(scores)))
    powers = computed(parts, _power=F.struct(*(F.pow(F.greatest(F.col(f"_part.{x}"), F.lit(1e-12)), 1 / temperature).alias(x) for x in V.NLI_LABELS)))
    p = F.col("_power")
    total = p["entailment"] + p["contradiction"] + p["neutral"]
    return powers.withColumn(out, F.struct(*(F.round(p[x] / total, 6).alias(x) for x in V.NLI_LABELS))).drop("_part", "_power")


def with_thresholds(scores: Column, entailment: Column | float, contradiction: Column | float) -> Column:
    """The top label if it reaches its threshold, else neutral."""
    label = top_label(scores)
    return F.when((label == "entailment") & (scores["entailment"] >= entailment), label).when((label == "contradiction") & (scores["contradiction"] >= contradiction), label).otherwise("neutral")


def fit_temperature(rows: DataFrame, candidates: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0)) -> DataFrame:
    """(temperature, loss), the first candidate of least negative log likelihood. ``rows``: (scores struct, gold)."""
    tried = rows.withColumn("temperature", F.explode(F.array(*(F.lit(c) for c in candidates))))
    tried = with_temperature(tried, F.col("temperature"), out="softened")
    p = F.col("softened")
    chance = F.when(F.col("gold") == "entailment", p["entailment"]).when(F.col("gold") == "contradiction", p["contradiction"]).otherwise(p["neutral"])
    loss = tried.groupBy("temperature").agg(F.round(F.sum(-F.log(F.greatest(chance, F.lit(1e-12)))), 6).alias("loss"))
    return loss.orderBy("loss", "temperature").limit(1)


def threshold_grid(rows: DataFrame, steps: int = 9) -> DataFrame:
    """(t_ent, t_con, macro_f1) of every pair of thresholds .1 to .9. ``rows``: (scores, gold). Partial counts first."""
    levels = F.array(*(F.lit(round((i + 1) / 10, 1)) for i in range(steps)))
    grid = rows.withColumn("t_ent", F.explode(levels)).withColumn("t_con", F.explode(levels))
    predicted = grid.withColumn("predicted", with_thresholds(F.col("scores"), F.col("t_ent"), F.col("t_con")))
    from .metrics import f1_columns

    return predicted.groupBy("t_ent", "t_con").agg(*f1_columns("gold", "predicted"))


def best_thresholds(grid: DataFrame) -> DataFrame:
    """The pair of thresholds of the largest macro-F1; of equal ones the smallest contradiction threshold within the smallest
    entailment threshold."""
    return grid.orderBy(F.desc("macro_f1"), "t_ent", "t_con").limit(1)


def best_pairs(results: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Per sample and label the first pair with the largest score: (sample, label, ord, score)."""
    spread = results.select(sample, "ord", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.lit(i).alias("label_ord"), F.col(f"scores.{x}").alias("score")) for i, x in enumerate(V.NLI_LABELS)))).alias("s")).select(sample, "ord", "s.*")
    order = Window.partitionBy(sample, "label").orderBy(F.desc("score"), "ord")
    return spread.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
