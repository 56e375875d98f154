"""Cutting documents into chunks: fixed token windows, and sentence groups of a target size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V

SENTENCE_CHUNKS = "doc_id string, chunk_no int, char_start bigint, char_end bigint, sentence_start int, sentence_end int, chunk string"


def window_chunks(documents: DataFrame, size: int = 160, overlap: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, n_tokens, chunk): windows of ``size`` white-space tokens, each starting size - overlap after the
    one before; the window that reaches the end is the last. Null and blank texts have none. Native, no shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    n = F.size("tokens")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    windows = documents.select(key, tokens.alias("tokens")).where(F.size("tokens") > 0).select(key, "tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.slice("tokens", F.col("chunk_no") * step + 1, F.lit(size))
    return windows.select(key, "chunk_no", part.alias("part")).select(key, "chunk_no", F.size("part").alias("n_tokens"), F.array_join("part", " ").alias("chunk"))


_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(-])")
_PARAGRAPH = re.compile(r"\n\s*\n+")
_INITIAL = re.compile(r"\b([A-Z])\.")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_GUARD = "\0"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences: within paragraphs, at . ! ? before a capital, digit, quote, bracket or dash; common
    abbreviations and single capitals end nothing."""
    spans, at = [], 0
    gaps = [m.span() for m in _PARAGRAPH.finditer(text)] + [(len(text), len(text))]
    for gap_start, gap_end in gaps:
        body = text[at:gap_start]
        for name in V.ABBREVIATIONS:
            body = body.replace(name, name.replace(".", _GUARD))
        body = _INITIAL.sub(rf"\1{_GUARD}", body)
        cuts = [0, *(x for m in _BOUNDARY.finditer(body) for x in m.span()), len(body)]
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            piece = body[a:b]
            if piece.strip():
                spans.append((at + a + len(piece) - len(piece.lstrip()), at + b - len(piece) + len(piece.rstrip())))
        at = gap_end
    return spans


def sentence_groups(sizes: np.ndarray, target: int, most: int, least: int, overlap: int) -> np.ndarray:
    """(first, end) sentence numbers, one row a group, by prefix sums of the sizes.

    Where a group ends depends on its start alone, so the ends of all possible starts are looked up at once: the first
    place that has ``target`` tokens and ``least`` sentences, but no further than ``most`` tokens allow (never less than
    least - 1 sentences); a sentence of ``most`` tokens stands alone. Then the starts are followed, each ``overlap``
    sentences before the last end. A rest of fewer than ``least`` sentences goes to a later group that has room for it."""
    n = len(sizes)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    start = np.arange(n)
    full = np.maximum(np.searchsorted(upto, upto[:-1] + target, "left"), start + least)
    room = np.maximum(np.searchsorted(upto, upto[:-1] + most, "right") - 1, start + least - 1)
    ends = np.where(sizes >= most, start + 1, np.clip(np.minimum(full, room), start + 1, n))
    takes_rest = (n - ends < least) & (upto[n] - upto[:-1] <= most)
    groups, at = [], 0
    while at < n:
        end = n if groups and takes_rest[at] else int(ends[at])
        groups.append((at, end))
        at = n if end == n else max(at + 1, end - overlap)
    return np.array(groups, np.int64).reshape(-1, 2)


#: What makes a chunk look like a fragment, by name: tests on columns of chunks (tokens, tokens with a letter, first and
#: last character, whether marker tokens occur) and the least number of tokens wanted.
FRAGMENT_SIGNS = {
    "small": lambda c, least: c["tokens"] < max(least // 2, 1),
    "few_words": lambda c, least: c["words"] <= 2,
    "odd_start": lambda c, least: ~c["starts_well"],
    "markers": lambda c, least: c["marked"],
    "short_and_open": lambda c, least: (c["tokens"] <= 6) & ~c["closed"],
}


def merged_groups(groups: np.ndarray, pieces: list[str], tokens: np.ndarray, words: np.ndarray, least_tokens: int) -> np.ndarray:
    """Groups of fewer than ``least_tokens`` tokens and those with a sign of a fragment go to the group before."""
    columns = {
        "tokens": tokens,
        "words": words,
        "starts_well": np.array([p[0].isalnum() and not p[0].islower() for p in pieces], bool),
        "marked": np.array([any(m in p for m in V.MARKER_TOKENS) for p in pieces], bool),
        "closed": np.array([p[-1] in ".!?" for p in pieces], bool),
    }
    kept = (tokens >= least_tokens) & ~np.logical_or.reduce([sign(columns, least_tokens) for sign in FRAGMENT_SIGNS.values()])
    kept[:1] = True
    heads = np.flatnonzero(kept)
    return np.column_stack((groups[heads, 0], np.maximum.reduceat(groups[:, 1], heads))) if len(heads) else groups


def sentence_chunks(documents: DataFrame, target: int = 96, most: int = 144, least: int = 2, overlap: int = 1, least_tokens: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SENTENCE_CHUNKS rows. With ``least_tokens`` > 0, short or fragmentary groups are appended to the group before.

    Null and blank texts have no chunks; repeated rows give repeated chunks. Each text is cut in the task that reads
    it, in linear time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = body.replace("\r\n", "\n").replace("\r", "\n")
                spans = sentence_spans(body)
                found = [_TOKEN.findall(body[s:e]) for s, e in spans]
                groups = sentence_groups(np.fromiter(map(len, found), np.int64, len(found)), target, most, least, overlap)
                if least_tokens and len(groups):
                    # Sentences cover everything but white space, so what a group holds is the sum over its sentences.
                    tokens = np.cumsum([0, *map(len, found)])
                    words = np.cumsum([0, *(sum(not t.isdigit() for t in f) for f in found)])
                    of = lambda sums: sums[groups[:, 1]] - sums[groups[:, 0]]  # noqa: B023, E731
                    groups = merged_groups(groups, [body[spans[a][0] : spans[b - 1][1]] for a, b in groups], of(tokens), of(words), least_tokens)
                for no, (a, b) in enumerate(groups.tolist()):
                    start, end = spans[a][0], spans[b - 1][1]
                    flat = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", body[start:end])).strip()
                    out.append((doc, no, start, end, a, b - 1, flat))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SENTENCE_CHUNKS.split(", ")])

    return documents.where(F.col(text).isNotNull()).select(F.col(key).cast("string"), text).mapInArrow(cut, SENTENCE_CHUNKS)
