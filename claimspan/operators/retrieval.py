"""Retrieval: token index and BM25, hash embeddings and exact nearest neighbours, fusion, re-ranking, hygiene, diversity.

Queries are a DataFrame (query_id, query); candidates are rows (query_id, doc_id, score..., rank). All queries run at
once: they are taken in blocks of bounded size that go to the executors in a broadcast, and every task scores its own
documents against a block, keeps the k best a query, and hands on only those. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..runtime import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries that meet the documents at once, and documents of a task scored at once.
QUERY_BLOCK, SCORED = 2048, 256


def build_index(corpus: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, tokens, dl) and the columns ``keep``, stored: every text is cut into tokens once, whatever is asked later.

    Null and empty texts have no tokens but count as documents."""
    return cut(spread(corpus.select(key, *keep, text)).select(key, *keep, T.token_list(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens")))


def write_index(index: DataFrame, folder: str) -> None:
    """The index and its token frequencies as Parquet; ``read_index`` and ``read_frequencies`` give them back."""
    index.write.mode("overwrite").parquet(f"{folder}/index")
    token_frequencies(index).write.mode("overwrite").parquet(f"{folder}/frequencies")


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/frequencies")


def postings(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, key, tf, dl): counted within each Arrow batch, so documents are not shuffled."""
    kind = index.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, word, tf, words = _term_counts(batch.column(1))
            dl = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), batch.column(0).take(pa.array(doc)), pa.array(tf), pa.array(dl[doc], pa.int32())], names=["token", key, "tf", "dl"])

    return index.select(key, "tokens").mapInArrow(count, f"token string, {key} {kind}, tf bigint, dl int")


def _term_counts(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, word number, times) of each distinct word of each row, and the words by number."""
    coded = pc.list_flatten(tokens).dictionary_encode()
    words = max(len(coded.dictionary), 1)
    cell, times = np.unique(np.asarray(pc.list_parent_indices(tokens)).astype(np.int64) * words + np.asarray(coded.indices), return_counts=True)
    return cell // words, cell % words, times, coded.dictionary


def token_frequencies(index: DataFrame) -> DataFrame:
    """(token, df, total): documents with the token and times it occurs, counted within batches first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, word, times, words = _term_counts(batch.column(0))
            df, total = np.bincount(word, minlength=len(words)), np.bincount(word, times, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words, pa.array(df), pa.array(total)], names=["token", "df", "total"])

    return index.select("tokens").mapInArrow(count, "token string, df bigint, total bigint").groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf)"""
    return queries.select("query_id", F.explode(T.token_list(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def ranked(rows: DataFrame, score: Column, k: int, key: str = "doc_id") -> DataFrame:
    """Rank 1..k per query by score, ties by key. Spark keeps only k rows a query before the shuffle (window group limit)."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The k best documents of each query of a block that a task has seen so far; ties go to the smaller key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, seen: np.ndarray | None, keys: np.ndarray) -> None:
        """``scores`` (documents x queries); only cells in ``seen`` count."""
        hit = scores >= self.floor
        doc, query = np.nonzero(hit if seen is None else hit & seen)
        if not len(doc):
            return
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, scores[doc, query]))
        key = keys[doc] if self.key is None else np.concatenate((self.key, keys[doc]))
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, query))
        query, score, key = query[order], score[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.key = query[kept], score[kept], key[kept]
        full = place == self.k - 1
        self.floor[query[full]] = score[full]

    def batch(self, queries: pa.Array, key: str, kind: pa.DataType) -> pa.RecordBatch:
        keys = pa.array([] if self.key is None else self.key.tolist(), kind)
        return pa.RecordBatch.from_arrays([queries.take(pa.array(self.query)), keys, pa.array(self.score)], names=["query_id", key, "score"])


def _keys(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist()) if len(column) else np.zeros(0, np.int64)


def _in_blocks(queries: DataFrame, size: int) -> Iterator[DataFrame]:
    """The rows in parts of about ``size`` queries, by hash of query_id."""
    count = queries.select("query_id").distinct().count()
    blocks = -(-count // size)
    for i in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def score_tokens(weights: DataFrame, index: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score, rank) of the k best documents by the sum over shared tokens of weight times ``part(tf, dl)``,
    to four places.

    ``weights`` (query_id, token, weight) goes out in blocks of QUERY_BLOCK queries; each block is one pass over the
    stored index, in which a task holds a block and a running list of its best documents. Only documents that share a
    token are ranked."""
    kinds = weights.schema["query_id"].dataType.simpleString(), index.schema[key].dataType.simpleString()
    context = index.sparkSession.sparkContext
    found: DataFrame | None = None
    for rows in _in_blocks(weights, QUERY_BLOCK):
        table = rows.orderBy("token", "query_id").toArrow()
        if not len(table):
            continue
        coded, ids = table["token"].combine_chunks().dictionary_encode(), table["query_id"].combine_chunks().dictionary_encode()
        first = np.searchsorted(np.asarray(coded.indices), np.arange(len(coded.dictionary) + 1))
        shared = context.broadcast((ids.dictionary, {w: i for i, w in enumerate(coded.dictionary.to_pylist())}, first, np.asarray(ids.indices).astype(np.int64), np.asarray(table["weight"].combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, number, first, query, weight = shared.value
            best, kind = _Best(len(queries), k), pa.int64()
            for whole in batches:
                kind = whole.schema.field(0).type
                for start in range(0, whole.num_rows, SCORED):
                    batch = whole.slice(start, SCORED)
                    doc, word, tf, words = _term_counts(batch.column(1))
                    asked = np.array([number.get(w, -1) for w in words.to_pylist()], np.int64)[word] if len(word) else word
                    held = asked >= 0
                    doc, asked = doc[held], asked[held]
                    dl = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
                    worth = part(tf[held].astype(np.float64), dl[doc].astype(np.float64))
                    times = first[asked + 1] - first[asked]
                    at = np.repeat(first[asked] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                    cell = np.repeat(doc, times) * len(queries) + query[at]
                    shape = batch.num_rows, len(queries)
                    total = np.bincount(cell, np.repeat(worth, times) * weight[at], minlength=shape[0] * shape[1]).reshape(shape)
                    seen = np.zeros(shape[0] * shape[1], bool)
                    seen[cell] = True
                    best.add(np.floor(total * 1e4 + 0.5) / 1e4, seen.reshape(shape), _keys(batch.column(0)))
            yield best.batch(queries, key, kind)

        hits = index.select(key, "tokens").mapInArrow(score, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = index.sparkSession.createDataFrame([], f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    return ranked(found, F.col("score"), k, key)


def inverse_frequencies(frequencies: DataFrame, documents: int) -> DataFrame:
    """(token, idf): ln((N - df + .5) / (df + .5)), negative ones replaced by EPSILON times the mean over all tokens."""
    raw = frequencies.withColumn("raw", F.log((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def matches(filters: dict[str, object], columns: list[str]) -> Column:
    """Whether every filter holds: the column of that name or, else, that entry of ``metadata`` has the value."""
    test = F.lit(True)
    for name, value in filters.items():
        ways = [F.col(name).eqNullSafe(F.lit(value))] if name in columns else []
        ways += [F.col("metadata")[name].eqNullSafe(F.lit(value))] if "metadata" in columns else []
        if not ways:
            raise ValueError(f"no column {name!r} and no metadata to filter on")
        test = test & (ways[0] if len(ways) == 1 else ways[0] | ways[1])
    return test


def search_index(queries: DataFrame, index: DataFrame, k: int, key: str = "doc_id", filters: dict[str, object] | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """BM25 over a stored index: (query_id, key, score, rank) of the k best documents that share a token with the query.

    Repeated query words count repeatedly; empty queries and texts match nothing. Statistics are over the whole corpus;
    ``filters`` only decide which documents may be found. ``frequencies`` (token, df) saves counting them."""
    size = index.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    asked = query_tokens(queries)
    idf = inverse_frequencies(token_frequencies(index) if frequencies is None else frequencies, size["n"])
    weights = asked.join(idf, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    mean = size["mean"] or 1.0
    found = index if not filters else index.where(matches(filters, index.columns))
    return score_tokens(cut(weights), found, lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), k, key)


def bm25(queries: DataFrame, corpus: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``search_index`` over an index of the corpus made for this call."""
    return search_index(queries, build_index(corpus, key, text), k, key)


def bm25_local(queries: DataFrame, corpus: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fallback variant: idf = ln((dl - tf + .5) / (tf + .5) + 1) from the document alone, query words as a set."""
    index = build_index(corpus, key, text)
    mean = index.agg(F.avg("dl").alias("mean")).first()["mean"] or 1.0
    weights = cut(query_tokens(queries).select("query_id", "token", F.lit(1.0).alias("weight")))

    def part(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return np.log((dl - tf + 0.5) / (tf + 0.5) + 1.0) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))

    return score_tokens(weights, index, part, k, key)


def hash_dimensions(corpus: DataFrame, dim: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dim, value): signed token counts by hashed dimension, before normalising; zeros are left out."""
    digest = F.sha2(F.col("token"), 256)
    at = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    tokens = corpus.select(key, F.explode(T.token_list(F.col(text))).alias("token"))
    return tokens.groupBy(key, at.alias("dim")).agg(F.sum(sign).alias("value")).where("value <> 0")


class _HashWords(dict):
    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, float]:
        digest = hashlib.sha256(token.encode()).digest()
        if len(self) > 500_000:
            self.clear()
        found = self[token] = int.from_bytes(digest[:4]) % self.dim, 1.0 if digest[4] % 2 == 0 else -1.0
        return found


def hash_vectors(corpus: DataFrame, dim: int = 256, key: str = "doc_id", text: str = "text", unit: bool = True) -> DataFrame:
    """(key, vector): the same as vectors, of length 1 if ``unit``; texts without tokens have the zero vector."""
    kind = corpus.schema[key].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _HashWords(dim)
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for i, tokens in enumerate(batch.column(1).to_pylist()):
                for t in tokens or ():
                    at, sign = words[t]
                    out[i, at] += sign
            if unit:
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out /= np.where(norm > 0, norm, 1)
            vectors = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "vector"])

    return spread(corpus.select(key, text)).select(key, T.token_list(F.col(text)).alias("tokens")).mapInArrow(embed, f"{key} {kind}, vector array<float>")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", block: int = QUERY_BLOCK, filters: dict[str, object] | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k vectors of largest cosine for each query vector, exactly, to six places.

    queries (query_id, vector) go out in blocks of bounded size; each block is one pass over the vectors, in matrix
    products, with a running list of the best in each task. A vector of zero length scores 0; null vectors are left out.
    ``filters`` are applied before anything is compared."""
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    context = vectors.sparkSession.sparkContext
    searched = (vectors if not filters else vectors.where(matches(filters, vectors.columns))).where(F.col("vector").isNotNull()).select(key, "vector")

    def unit(column: pa.ListArray) -> np.ndarray:
        out = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    found: DataFrame | None = None
    for rows in _in_blocks(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), block):
        table = rows.orderBy("query_id").toArrow()
        if not len(table):
            continue
        shared = context.broadcast((table["query_id"].combine_chunks(), unit(table["vector"].combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best, kind = _Best(len(ids), k), pa.int64()
            for whole in batches:
                kind = whole.schema.field(0).type
                for start in range(0, whole.num_rows, SCORED):
                    batch = whole.slice(start, SCORED)
                    best.add(np.floor(unit(batch.column(1)) @ asked.T * 1e6 + 0.5) / 1e6, None, _keys(batch.column(0)))
            yield best.batch(ids, key, kind)

        hits = searched.mapInArrow(score, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    return ranked(found, F.col("score"), k, key)


def min_max(score: str) -> Column:
    """Score scaled to 0..1 within its query; all equal gives 1."""
    per_query = Window.partitionBy("query_id")
    low, high = F.min(score).over(per_query), F.max(score).over(per_query)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))


def fuse(sparse: DataFrame, dense: DataFrame, k: int, alpha: float = 0.55, key: str = "doc_id") -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over scaled scores, a missing side counts 0. Ties: sparse rank, then dense rank."""
    left = sparse.select("query_id", key, min_max("score").alias("sparse"), F.col("rank").alias("sparse_rank"))
    right = dense.select("query_id", key, min_max("score").alias("dense"), F.col("rank").alias("dense_rank"))
    both = left.join(right, ["query_id", key], "full_outer").na.fill(0.0, ["sparse", "dense"])
    fused = both.withColumn("score", F.round(alpha * F.col("dense") + (1 - alpha) * F.col("sparse"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("sparse_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "sparse", "dense", "rank")


def rerank_lexical(candidates: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Candidates (query_id, query, key, text, rank) by multiset overlap with the query, ties in their former order."""
    scored = candidates.withColumn("rerank_score", T.multiset_overlap(T.token_list(F.col("query")), T.token_list(F.col("text"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pre_rerank_rank")
    return scored.withColumnRenamed("rank", "pre_rerank_rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def base_score(rerank: Column, hybrid: Column, dense: Column, sparse: Column) -> Column:
    """The first of the scores that is neither null nor 0; else 0."""
    return F.coalesce(*(F.nullif(s, F.lit(0.0)) for s in (rerank, hybrid, dense, sparse)), F.lit(0.0))


def hygiene(candidates: DataFrame, base: str, weight: float = 0.35, min_tokens: int = 6, skip_at: float = 0.85, text: str = "text") -> DataFrame:
    """Adds flags, penalty, adjusted_score and skip. Tokens are lower case by then, so the two rules that look for title
    case never fire; they are left out."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    tokens = T.token_list(t)
    count, verbs = F.size(tokens), F.size(F.filter(tokens, lambda w: w.isin(*V.VERB_HINTS)))
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    markers = sum(((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m) for m in V.MARKER_TOKENS), F.lit(0.0))
    starts = F.lit(False)
    for prefix in V.ATTRIBUTION_PREFIXES:
        starts = starts | F.lower(t).startswith(prefix)
    rules = (
        ("ultra_short_non_propositional", 0.55, (count < min_tokens) & (verbs == 0)),
        ("parenthetical_heavy", 0.2, (markers >= 2) | (markers / F.greatest(count, F.lit(1)) >= 0.12)),
        ("attribution_or_appositive_heavy", 0.15, starts),
        ("entity_or_appositive_heavy", 0.25, (verbs == 0) & (commas >= 2) & (count <= 14)),
    )
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, _, test in rules)))
    penalty = F.least(F.round(sum((F.when(test, F.lit(p)).otherwise(0.0) for _, p, test in rules), F.lit(0.0)), 4), F.lit(1.0))
    out = candidates.withColumn("flags", flags).withColumn("penalty", penalty)
    bad = F.arrays_overlap("flags", F.array(F.lit("ultra_short_non_propositional"), F.lit("entity_or_appositive_heavy")))
    return out.withColumn("adjusted_score", F.round(F.col(base) - weight * F.col("penalty"), 6)).withColumn("skip", (F.col("penalty") >= skip_at) & bad)


def hygiene_order(assessed: DataFrame) -> DataFrame:
    """Kept before skipped, then by adjusted score, then by former rank: ranks anew."""
    order = Window.partitionBy("query_id").orderBy("skip", F.desc("adjusted_score"), "rank")
    return assessed.withColumn("hygiene_rank", F.row_number().over(order))


def retrieve(
    queries: DataFrame,
    documents: DataFrame,
    index: DataFrame,
    vectors: DataFrame,
    top_k: int = 8,
    mode: str = "hybrid",
    filters: dict[str, object] | None = None,
    rerank: bool = True,
    diverse: bool = True,
    min_sources: int = 2,
    per_source: int = 2,
    prefer_recent: bool = False,
    pool: int = 24,
    key: str = "doc_id",
) -> DataFrame:
    """Evidence for every query: (query_id, query, key, the columns of ``documents``, score, rank).

    mode bm25, dense or hybrid finds max(3 * top_k, pool) candidates; they are re-ranked by lexical overlap, diversified by
    source and cut to top_k. ``score`` is the first score in the order re-ranking, hybrid, dense, sparse that is not 0.
    With ``prefer_recent`` later publication adds to the score before diversification. ``index`` and ``vectors`` (key,
    vector) are built beforehand; a document needs key, text and source, and published_at to prefer recent ones."""
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    candidates = max(3 * top_k, pool)
    none = F.lit(None).cast("double")
    if mode != "bm25":
        near = nearest(hash_vectors(queries, key="query_id", text="query", unit=False), vectors, candidates, key, filters=filters)
    if mode != "dense":
        common = search_index(queries, index, candidates, key, filters)
    if mode == "hybrid":
        hits = fuse(common, near, candidates, key=key).withColumnRenamed("score", "hybrid_score")
    elif mode == "bm25":
        hits = common.select("query_id", key, none.alias("hybrid_score"), F.col("score").alias("sparse"), none.alias("dense"), "rank")
    else:
        hits = near.select("query_id", key, none.alias("hybrid_score"), none.alias("sparse"), F.col("score").alias("dense"), "rank")
    found = hits.join(queries.select("query_id", "query"), "query_id").join(documents, key)
    if rerank:
        found = rerank_lexical(found, candidates, key).drop("pre_rerank_rank")
    else:
        found = found.withColumn("rerank_score", none)
    score = base_score(F.col("rerank_score"), F.col("hybrid_score"), F.col("dense"), F.col("sparse"))
    scored = found.withColumn("score", score).drop("rerank_score", "hybrid_score", "dense", "sparse")
    if not diverse:
        return scored.where(F.col("rank") <= top_k)
    return diversified(scored, top_k, min_sources, per_source, prefer_recent, key)


def diversified(scored: DataFrame, top_k: int, min_sources: int, per_source: int, prefer_recent: bool = False, key: str = "doc_id") -> DataFrame:
    """Candidates (query_id, key, source, score, rank, ...) in order of score, diversified, with all their columns."""
    recency = F.coalesce(F.unix_timestamp(T.parse_time(F.col("published_at"))) / 1e10, F.lit(0.0)) if prefer_recent else F.lit(0.0)
    order = Window.partitionBy("query_id").orderBy((F.col("score") + recency).desc(), "rank")
    chosen = diversify(scored.withColumn("rank", F.row_number().over(order)), top_k, min_sources, per_source, key=key)
    return scored.drop("rank").join(chosen.select("query_id", key, "rank"), ["query_id", key])


def evidence_records(found: DataFrame, dataset: str, key: str = "doc_id") -> DataFrame:
    """Retrieved evidence as nested records (sample_id, query, metadata, retrieved_chunks), chunks in rank order.

    The source name becomes the medium; entries of a document's own ``metadata`` win over the ones made here."""
    have = set(found.columns)
    own = F.col("metadata") if "metadata" in have else F.create_map().cast("map<string,string>")
    made = F.map_from_entries(
        F.filter(
            F.array(
                *(
                    F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
                    for name, value in (
                        ("title", F.col("title") if "title" in have else F.lit(None)), ("source_doc_id", F.col(key)), ("dataset", F.lit(dataset)), ("source_name", F.col("source")),
                        ("published_at", F.col("published_at") if "published_at" in have else F.lit(None)),
                    )
                )
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    mine = F.map_filter(made, lambda k, _: ~F.map_contains_key(F.coalesce(own, F.create_map().cast("map<string,string>")), k))
    chunk = F.struct(
        "rank", F.col(key).cast("string").alias("chunk_id"), "text", F.col("score").alias("retrieval_score"), (F.col("source_url") if "source_url" in have else F.lit(None).cast("string")).alias("source_url"),
        F.col("source").alias("source_medium"), F.map_concat(mine, F.coalesce(own, F.create_map().cast("map<string,string>"))).alias("metadata"),
    )
    grouped = found.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(chunk.dropFields("metadata"))).alias("bare"), F.collect_list(F.struct("rank", chunk["metadata"].alias("metadata"))).alias("held"))
    chunks = F.transform("bare", lambda c: c.withField("metadata", F.filter("held", lambda h: h["rank"] == c["rank"])[0]["metadata"]))
    return grouped.select(F.col("query_id").cast("string").alias("sample_id"), "query", F.create_map(F.lit("dataset"), F.lit(dataset)).alias("metadata"), chunks.alias("retrieved_chunks"))


def diversify(candidates: DataFrame, k: int, min_sources: int = 2, per_source: int = 2, per_doc: int = 1, key: str = "doc_id") -> DataFrame:
    """First one document of each new source until ``min_sources``, then the rest under the caps, in rank order.

    Sequential by nature; a query's candidates (at most a few dozen after top-k) are one group. The result has at most
    k rows a query."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        sources, docs, chosen = {}, {}, []

        def take(i: int) -> None:
            row = group.iloc[i]
            sources[row["source_key"]] = sources.get(row["source_key"], 0) + 1
            docs[row[key]] = docs.get(row[key], 0) + 1
            chosen.append(i)

        def free(i: int) -> bool:
            row = group.iloc[i]
            return sources.get(row["source_key"], 0) < per_source and docs.get(row[key], 0) < per_doc

        for i in range(len(group)):
            if min_sources > 1 and len(sources) < min_sources and len(chosen) < k and group.iloc[i]["source_key"] not in sources and free(i):
                take(i)
        for i in range(len(group)):
            if len(chosen) < k and i not in chosen and free(i):
                take(i)
        out = group.iloc[chosen][["query_id", key, "source_key", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    rows = candidates.select("query_id", key, F.coalesce("source", F.col(key).cast("string")).alias("source_key"), "score", "rank")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, {key} {kinds[key]}, source_key string, score double, rank bigint")
