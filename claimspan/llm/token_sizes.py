"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Rank file of the tokenizer; must be readable on the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of this tokenizer family.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers the token count of, and the longest it remembers.
REMEMBERED, LONGEST = 200_000, 48
#: White space that word sums would get wrong.
_SPACES = re.compile(r"\s\s\s|\s\s$")


class TokenCounter:
    """Exact token counts. Pieces never reach over a space that follows a non-space, so a text's count is the sum over
    its space-separated words, each counted once while remembered; texts with longer runs of white space are encoded
    whole."""

    _loaded: dict[str, TokenCounter] = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> TokenCounter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_length(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def count(self, text: str) -> int:
        if _SPACES.search(text):
            return self.encode_length(text)
        words, known, total = text.split(" "), self.words, 0
        if words[0]:
            total = self.encode_length(words[0])
        for word in words[1:]:
            n = known.get(word)
            if n is None:
                n = self.encode_length(" " + word)
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


def token_sizes(rows: DataFrame, text: str = "text", size: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """``rows`` with the text replaced by its number of tokens (bigint); null texts have null. Narrow."""
    at = rows.columns.index(text)
    schema = StructType([StructField(size, LongType()) if i == at else f for i, f in enumerate(rows.schema)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.load(path)
        for batch in batches:
            sizes = [None if t is None else counter.count(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(sizes, pa.int64())
            names = list(batch.schema.names)
            names[at] = size
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(count, schema)
