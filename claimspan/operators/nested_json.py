"""Deeply nested JSON records as related flat tables with parent-child links.

``flatten_records`` reads bodies through the structural index and emits one row per node: the record itself, its
questions, answers, claims and NLI results, each with the place of its record in the body, its parent's place, its own
place and its JSON text. ``records_table`` and the others turn those rows into typed flat tables with JSON functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structural_json import OPEN_ARRAY, OPEN_OBJECT, STRING, StructuralIndex

NODE_SCHEMA = "record_id bigint, record_no int, node_kind string, parent_no int, child_no int, value_kind string, value string"
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("record_no", pa.int32()), ("node_kind", pa.string()), ("parent_no", pa.int32()), ("child_no", pa.int32()), ("value_kind", pa.string()), ("value", pa.string())]
)
#: Lists of a record, and what one element of each is called.
SECTIONS = {"questions": "question", "claims": "claim", "nli_results": "nli_result"}
#: Keys under which a body may wrap its records.
WRAPPERS = ("data", "records", "examples")
_NAMES = {k: k for k in (*SECTIONS, *WRAPPERS, "answers")}
#: Bytes of bodies indexed at once; a longer single body is indexed alone.
BLOCK_BYTES = 4 << 20


class _Rows:
    def __init__(self) -> None:
        self.columns: tuple[list, ...] = tuple([] for _ in _ARROW)

    def add(self, *row: object) -> None:
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(self.columns, _ARROW, strict=True)], schema=_ARROW)


def _kind(index: StructuralIndex, token: int) -> str:
    kind = index.kind[token]
    if kind == OPEN_OBJECT:
        return "object"
    if kind == OPEN_ARRAY:
        return "array"
    return "string" if kind == STRING else "scalar"


class _Walk:
    """Emits rows for one block of bodies. Strings that may hold a JSON array are collected and indexed together."""

    def __init__(self, rows: _Rows) -> None:
        self.rows = rows
        self.waiting: list[tuple[tuple, str]] = []

    def elements(self, index: StructuralIndex, token: int, link: tuple) -> None:
        """Elements of the list at ``token``. link: (record_id, record_no, parent_no, element kind)."""
        kind = index.kind[token]
        if kind == OPEN_ARRAY:
            for no, x in enumerate(index.children(token)):
                if not index.is_null(x):
                    self.emit(index, int(x), link, no)
        elif kind == OPEN_OBJECT:
            self.emit(index, token, link, 0)
        elif kind == STRING:
            held = index.string(token)
            if held.lstrip(" \t\r\n\ufeff")[:1] == "[":
                self.waiting.append((link, held))
            else:
                self.emit(index, token, link, 0)

    def emit(self, index: StructuralIndex, token: int, link: tuple, no: int) -> None:
        record_id, record_no, parent_no, node = link
        what = _kind(index, token)
        self.rows.add(record_id, record_no, node, parent_no, no, what, index.string(token) if what == "string" else index.text(token))
        if node == "question" and what == "object":
            answers = index.member(token, {"answers": "answers"}).get("answers")
            if answers is not None:
                self.elements(index, answers, (record_id, record_no, no, "answer"))

    def body(self, index: StructuralIndex, doc: int, record_id: int) -> None:
        root = index.root(doc)
        kind = index.kind[root]
        records: list[tuple[int, int]] = []
        if kind == OPEN_ARRAY:
            records = list(enumerate(index.children(root)))
        elif kind == OPEN_OBJECT:
            found = index.member(root, _NAMES)
            wrapped = next((found[w] for w in WRAPPERS if w in found and index.kind[found[w]] == OPEN_ARRAY), None)
            records = [(0, root)] if wrapped is None else list(enumerate(index.children(wrapped)))
        for no, token in records:
            if index.kind[token] == OPEN_OBJECT:
                self.rows.add(record_id, no, "record", 0, no, "object", index.text(token))
                for section, at in index.member(token, _NAMES).items():
                    if section in SECTIONS:
                        self.elements(index, at, (record_id, no, 0, SECTIONS[section]))

    def finish(self) -> None:
        while self.waiting:
            links, self.waiting = self.waiting, []
            index = StructuralIndex([text.lstrip("\ufeff").encode("utf-8", "surrogatepass") for _, text in links])
            for doc, (link, held) in enumerate(links):
                if index.valid[doc] and index.kind[index.root(doc)] == OPEN_ARRAY:
                    self.elements(index, index.root(doc), link)
                else:  # not a JSON array after all: a bare string
                    self.rows.add(link[0], link[1], link[3], link[2], 0, "string", held)


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > BLOCK_BYTES:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        bodies = [b.removeprefix(b"\xef\xbb\xbf") for b in batch.column(1).cast(pa.binary()).to_pylist()]
        for block in _blocks(np.fromiter(map(len, bodies), np.int64, len(bodies))):
            rows = _Rows()
            walk = _Walk(rows)
            index = StructuralIndex(bodies[block])
            for doc in np.flatnonzero(index.valid):
                walk.body(index, int(doc), ids[block][doc])
            walk.finish()
            yield rows.batch()


def flatten_records(bodies: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """All nodes of the JSON ``body`` column, as NODE_SCHEMA rows; no shuffle, each row from its own body.

    A body is one record, an array of records, or an object with an array under data, records or examples. A body
    that is null, empty, cut off or otherwise not one whole JSON document gives no rows; a leading byte order mark is
    ignored; array elements that are no objects are no records but keep their place. A list may be given as an array,
    as one object or bare string (an array of one) or as a string that holds a JSON array; null elements keep their
    place and give no row; a number, boolean or null in place of a list gives none. For a repeated key the last one
    counts. Repeated body rows give repeated nodes. Other columns are not read, so their names cannot clash.
    """
    return bodies.where(F.col(body).isNotNull()).select(F.col(key).cast("bigint"), body).mapInArrow(_flatten, NODE_SCHEMA)


def _node(nodes: DataFrame, kind: str, *columns: str) -> DataFrame:
    return nodes.where(F.col("node_kind") == kind).select("record_id", "record_no", *columns, "value_kind", "value")


def _field(path: str) -> F.Column:
    return F.when(F.col("value_kind") == "object", F.get_json_object("value", f"$.{path}"))


def records_table(nodes: DataFrame) -> DataFrame:
    named = ("sample_id", "query", "claim", "label", "speaker")
    return _node(nodes, "record").select("record_id", "record_no", *(_field(n).alias(n) for n in named))


def questions_table(nodes: DataFrame) -> DataFrame:
    text = F.when(F.col("value_kind") == "string", F.col("value")).otherwise(_field("question"))
    return _node(nodes, "question", "child_no").select("record_id", "record_no", F.col("child_no").alias("question_no"), text.alias("question"))


def answers_table(nodes: DataFrame) -> DataFrame:
    text = F.when(F.col("value_kind") == "string", F.col("value")).otherwise(_field("answer"))
    return _node(nodes, "answer", "parent_no", "child_no").select(
        "record_id", "record_no", F.col("parent_no").alias("question_no"), F.col("child_no").alias("answer_no"),
        text.alias("answer"), *(_field(n).alias(n) for n in ("answer_type", "source_url", "source_medium")),
    )


def claims_table(nodes: DataFrame) -> DataFrame:
    text = F.when(F.col("value_kind") == "string", F.col("value")).otherwise(_field("text"))
    return _node(nodes, "claim", "child_no").select(
        "record_id", "record_no", F.col("child_no").alias("claim_no"), _field("claim_id").alias("claim_id"), text.alias("text"),
        _field("source_metadata.role").alias("role"),
    )


def nli_results_table(nodes: DataFrame) -> DataFrame:
    return _node(nodes, "nli_result", "child_no").select(
        "record_id", "record_no", F.col("child_no").alias("nli_no"),
        *(_field(n).alias(n) for n in ("claim_a_id", "claim_b_id", "label")),
        F.expr("try_cast(case when value_kind = 'object' then get_json_object(value, '$.scores.entailment') end as double)").alias("entailment_score"),
    )
