"""Splitting oversized texts at natural boundaries, by lexical cohesion.

For each text above the limit, the similarity of the word blocks before and after every sentence gap is computed;
valleys in that curve are topic boundaries. Within each size window the deepest valley is cut, and every piece but the
first repeats a fixed number of characters of the piece before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "table_name string, item_key string, piece_no int, char_start bigint, char_end bigint, boundary string, piece string"
_ARROW = pa.schema(
    [("table_name", pa.string()), ("item_key", pa.string()), ("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("boundary", pa.string()), ("piece", pa.string())]
)
#: Sentences on each side of a gap that are compared, and how much deeper a line break counts than a sentence end.
BLOCK, BREAK_DEPTH = 6, 0.1
#: Rows handed on at once.
ROWS_OUT = 256
_SENTENCE_END = re.compile(r"(?:[.!?…।؟]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*|\n+)\s*")
_WORD = re.compile(r"[^\W\d_]{2,}|[぀-ヿ㐀-鿿]")
_SPACE = re.compile(r"\s+")


def sentence_gaps(text: str) -> np.ndarray:
    """Offsets just after each sentence end or line break and the white space that follows."""
    return np.fromiter((m.end() for m in _SENTENCE_END.finditer(text)), np.int64)


def word_weights(sentences: list[list[int]], words: int) -> list[int]:
    """Weight of each word in products of bags: the squared logarithm of how rare it is among the text's sentences, so that
    words of all topics count little. Whole numbers, so that sliding sums stay exact."""
    within = [0] * words
    for sentence in sentences:
        for w in set(sentence):
            within[w] += 1
    return [1 + round(1000 * log((1 + len(sentences)) / n) ** 2) for n in within]


def gap_depths(text: str, gaps: np.ndarray) -> np.ndarray:
    """How deep each gap lies in the curve of block similarity: the drop from the nearest peak on the left plus that
    on the right. A paragraph break is a little deeper than a plain sentence end.

    The words of the BLOCK sentences before and after a gap are kept as two bags that slide from gap to gap; what they
    share and their sizes are updated word by word, so a text of any length takes linear time and little memory."""
    edges = [0, *gaps.tolist(), len(text)]
    known: dict[str, int] = {}
    sentences = [[known.setdefault(m.group().lower(), len(known)) for m in _WORD.finditer(text, a, b)] for a, b in zip(edges, edges[1:], strict=False)]
    weight = word_weights(sentences, len(known))
    bags = ([0] * len(known), [0] * len(known))  # how often each word is in the block before, after the gap
    shared, squares = 0, [0, 0]

    def change(side: int, words: list[int], by: int) -> None:
        nonlocal shared
        mine, other = bags[side], bags[1 - side]
        for w in words:
            squares[side] += weight[w] * (by * 2 * mine[w] + 1)
            shared += weight[w] * by * other[w]
            mine[w] += by

    for words in sentences[:BLOCK]:
        change(1, words, 1)
    similar = np.zeros(len(gaps))
    for at in range(1, len(sentences)):
        change(1, sentences[at - 1], -1)
        change(0, sentences[at - 1], 1)
        if at + BLOCK - 1 < len(sentences):
            change(1, sentences[at + BLOCK - 1], 1)
        if at > BLOCK:
            change(0, sentences[at - 1 - BLOCK], -1)
        norm = squares[0] * squares[1]
        similar[at - 1] = shared / norm**0.5 if norm else 0.0
    depth = _climb(similar) + _climb(similar[::-1])[::-1]
    breaks = np.fromiter((text[max(g - 1, 0)] == "\n" for g in gaps), bool, len(gaps))
    return depth + BREAK_DEPTH * breaks


def _climb(curve: np.ndarray) -> np.ndarray:
    """For each point, how far the curve rises going left until it first falls."""
    out = np.zeros(len(curve))
    peak = 0.0
    for i, y in enumerate(curve.tolist()):
        peak = y if i == 0 or y > curve[i - 1] else peak
        out[i] = peak - y
    return out


def _hard_cut(text: str, low: int, high: int) -> int:
    """The last place in (low, high] that parts no combining mark, joiner or variation selector from its letter; ``high``
    if there is none, as in a cluster longer than a piece."""
    for at in range(high, low, -1):
        if at == len(text) or not (unicodedata.category(text[at])[0] == "M" or "\u200d" in text[at - 1 : at + 1]):
            return at
    return high


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, how the end was chosen) of the pieces; each but the first starts ``overlap`` characters before the
    end of the one before.

    The window of a piece is every place that ends it with something new and within the limit. The ways: topic (the
    deepest valley in the window; of equally deep ones the last), sentence (no valley but sentence ends: the last),
    space (between words, the last), none (an unbroken run), end."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("a limit above the overlap is needed")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    gaps = sentence_gaps(text)
    gaps = gaps[gaps < len(text)]
    depth = gap_depths(text, gaps) if len(gaps) else np.zeros(0)
    pieces, start = [], 0
    while len(text) - start > limit:
        fresh, high = start + overlap, start + limit  # a cut before ``fresh`` would repeat a whole piece
        a, b = np.searchsorted(gaps, (fresh, high), "right")
        last = None
        if a < b:
            at = b - 1 - int(np.argmax(depth[a:b][::-1]))
            end, how = int(gaps[at]), "topic" if depth[at] > 0 else "sentence"
        else:
            for last in _SPACE.finditer(text, fresh, high):
                pass
            if last is not None and last.end() > fresh:
                end, how = last.end(), "space"
            else:
                end, how = _hard_cut(text, fresh, high), "none"
        pieces.append((start, end, how))
        start = end - overlap
    return [*pieces, (start, len(text), "end")]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in _ARROW]

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        for c in columns:
            c.clear()
        return out

    for batch in batches:
        for name, key, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            for no, (start, end, how) in enumerate(split_text(text, limit, overlap)):
                for column, x in zip(columns, (name, key, no, start, end, how, text[start:end]), strict=True):
                    column.append(x)
                if len(columns[0]) >= ROWS_OUT:
                    yield flush()
    if columns[0]:
        yield flush()


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces (PIECES) of every item of ``items`` (table_name, item_key, field_name, text) above its limit.

    ``limits`` (field_name, max_size, overlap_size) has one row per field and is a small parameter table. Items at or
    below their limit, null texts and fields without a limit give no pieces. Repeated items give repeated pieces;
    extra columns are not read. Sizes are Unicode characters. A text is cut in the task that reads it, in linear time;
    a single very long text is one task's work.
    """
    sized = items.join(F.broadcast(limits.select("field_name", "max_size", "overlap_size")), "field_name")
    return (
        sized.where(F.length("text") > F.col("max_size"))
        .select("table_name", "item_key", "text", "max_size", "overlap_size")
        .mapInArrow(_split, PIECES)
    )
