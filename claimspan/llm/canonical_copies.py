"""Duplicates hidden by formatting differences.

Columns are dictionary-encoded. A record is a set of (field, value) pairs; within a task every distinct value is brought
to its canonical form once, and a pair is named by a digest. The dictionary gives every pair that occurs in more than
one record an integer (the others occur in one record only, which then has no copy). Records are rewritten as sorted
tuples of these integers, and equal tuples are one record.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.structural_json import CLOSE_ARRAY, CLOSE_OBJECT, OPEN_ARRAY, OPEN_OBJECT, SCALAR, STRING, StructuralIndex
from ..runtime import cut, join_one_sided_hot, spread

RECORDS = "item_key string, pairs array<struct<pair: binary, proof: bigint>>"
_PAIR = pa.struct([("pair", pa.binary()), ("proof", pa.int64())])
_ARROW = pa.schema([("item_key", pa.string()), ("pairs", pa.list_(_PAIR))])
#: Distinct short values kept by a worker between batches.
REMEMBERED, SHORT = 100_000, 64
#: Dictionary entries numbered in one window group, about.
NUMBERED = 500_000


#: Marks between digits are lifted here (private use) while the rest is dropped.
_LIFT = 0xF0000
_LETTERS = bytes(c for c in range(128) if chr(c).isalnum())
_ASCII_DROP = bytes(c for c in range(128) if c not in _LETTERS)
_ASCII_LIFT = bytes(c + 128 if c in _ASCII_DROP else c for c in range(256))
_ASCII_LOWER = bytes(c - 128 if c > 127 else c for c in range(256))
_ASCII_FIGURE = re.compile(rb"[0-9](?:[!-/:-@\[-`{-~][0-9])+")
_FIGURE = re.compile(r"\d(?:[^\w\s]\d|_\d)+")
_LIFTED = re.compile(f"[{chr(_LIFT)}-{chr(sys.maxunicode)}]")


class _Kept(dict):
    """For str.translate: letters, combining marks and numerals as they are, lifted marks back in place, the rest dropped."""

    def __missing__(self, code: int) -> int | None:
        if code >= _LIFT:
            kept = code - _LIFT
        else:
            kept = code if unicodedata.category(chr(code))[0] in "LMN" else None
        self[code] = kept
        return kept


_KEPT = _Kept()


def _lift(figure: re.Match) -> str:
    return "".join(chr(_LIFT + ord(c)) if ord(c) < 0x20000 and unicodedata.category(c)[0] in "PS" else c for c in figure.group())


def canonical_text(text: str) -> str:
    """Lower case, only letters, combining marks and numerals, and any one mark or symbol directly between two digits."""
    text = text.lower()
    if text.isascii():
        raw = _ASCII_FIGURE.sub(lambda m: m.group().translate(_ASCII_LIFT), text.encode())
        return raw.translate(_ASCII_LOWER, _ASCII_DROP).decode()
    if _LIFTED.search(text):  # private-use characters of the text itself mean nothing
        text = _LIFTED.sub(" ", text)
    return _FIGURE.sub(_lift, text).translate(_KEPT)


def _named(pair: bytes) -> dict:
    """A pair's 128-bit name, and 64 bits of another function that prove two pairs of one name to be the same."""
    return {"pair": xxhash.xxh3_128_digest(pair), "proof": xxhash.xxh64_intdigest(pair) - (1 << 63)}


def _text_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = pc.dictionary_encode(batch.column(1).cast(pa.string()))
        forms = map(canonical_text, coded.dictionary.to_pylist())
        pairs = pa.array([[_named(f.encode("utf-8", "surrogatepass"))] if f else None for f in forms], _ARROW.field(1).type).take(coded.indices)
        yield pa.RecordBatch.from_arrays([batch.column(0), pairs], schema=_ARROW).filter(pairs.is_valid())


def _number(text: str) -> str:
    try:
        number = Decimal(text)
    except InvalidOperation:
        return text
    if number == 0:
        return "0"
    sign, digits, exponent = number.normalize().as_tuple()
    return f"{'-' if sign else ''}{''.join(map(str, digits))}e{exponent}"


class _Pairs(dict):
    """Name of each distinct (field, kind, value), computed once while it is remembered."""

    def __missing__(self, key: tuple[bytes, str, str]) -> dict:
        field, kind, value = key
        form = canonical_text(value) if kind == "s" else _number(value) if kind == "n" else value
        found = _named(field + f"{kind}{form}".encode("utf-8", "surrogatepass"))
        if len(value) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class _Fields(dict):
    """Name of a field from that of the one around it and its own key or place, whatever the depth."""

    def __missing__(self, step: tuple[bytes, str]) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[step] = xxhash.xxh3_128_digest(step[0] + step[1].encode("utf-8", "surrogatepass"))
        return found


class _Number(str):
    __slots__ = ()


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number)
_CONSTANTS = {"true": True, "false": False, "null": None}


def decode_deep(body: str) -> object:
    """The same as the JSON module's decoder for nesting of any depth, from a structural index, without recursion."""
    index = StructuralIndex([body.encode("utf-8", "surrogatepass")])
    if not index.valid[0]:
        raise ValueError("not one JSON document")
    top: list = []
    around: list = [top]
    key = None
    for token, kind in enumerate(index.kind.tolist()):
        if kind in (CLOSE_OBJECT, CLOSE_ARRAY):
            around.pop()
            continue
        if kind == STRING and index.is_key[token]:
            key = index.string(token)
            continue
        if kind in (OPEN_OBJECT, OPEN_ARRAY):
            value: object = {} if kind == OPEN_OBJECT else []
        elif kind == STRING:
            value = index.string(token)
        elif kind == SCALAR:
            text = index.text(token)
            value = _CONSTANTS[text] if text in _CONSTANTS else _Number(text)
        else:
            continue
        if isinstance(around[-1], dict):
            around[-1][key] = value
        else:
            around[-1].append(value)
        if kind in (OPEN_OBJECT, OPEN_ARRAY):
            around.append(value)
    return top[0]


def decode(body: str) -> object:
    try:
        return _DECODER.decode(body)
    except RecursionError:
        return decode_deep(body)


def _leaves(held: object, fields: _Fields, pairs: _Pairs) -> list[dict]:
    """Names of all (field, leaf) pairs. Array places are part of the field; empty containers are leaves."""
    out, stack = [], [(held, b"")]
    while stack:
        held, field = stack.pop()
        if isinstance(held, dict):
            if not held:
                out.append(pairs[field, "c", "{}"])
            stack.extend((v, fields[field, f".{k}"]) for k, v in held.items())
        elif isinstance(held, list):
            if not held:
                out.append(pairs[field, "c", "[]"])
            stack.extend((v, fields[field, f"[{i}"]) for i, v in enumerate(held))
        elif isinstance(held, _Number):
            out.append(pairs[field, "n", str(held)])
        elif isinstance(held, str):
            out.append(pairs[field, "s", held])
        else:
            out.append(pairs[field, "c", str(held)])
    return out


def _json_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, fields = _Pairs(), _Fields()
    for batch in batches:
        coded = pc.dictionary_encode(batch.column(1).cast(pa.string()))
        named = []
        for body in coded.dictionary.to_pylist():
            try:
                held = decode(body.lstrip("\ufeff"))
            except ValueError:
                held = None
            named.append(_leaves(held, fields, pairs) if isinstance(held, dict) else None)
        records = pa.array(named, _ARROW.field(1).type).take(coded.indices)
        yield pa.RecordBatch.from_arrays([batch.column(0), records], schema=_ARROW).filter(records.is_valid())


def record_pairs(rows: DataFrame, key: str, value: str, as_json: bool = False) -> DataFrame:
    """RECORDS of the rows whose value leaves something: null, empty and mark-only texts give none, nor do bodies that are
    not one JSON object; nesting may be of any depth. Narrow: no shuffle."""
    return (
        spread(rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, value))
        .select(F.col(key).cast("string").alias("item_key"), F.col(value).alias("value"))
        .mapInArrow(_json_records if as_json else _text_records, RECORDS)
    )


def dictionary(records: DataFrame) -> DataFrame:
    """(table_name, pair, number, uses): a whole number for every pair that more than one record of its table has.

    Uses are counted map-side. Numbers run within hash buckets of the pairs, each bucket starting where the earlier ones
    end, so no task sees the whole dictionary. Two different pairs of one name raise an error."""
    uses = records.select("table_name", F.explode("pairs").alias("p")).groupBy("table_name", "p.pair").agg(F.count("*").alias("uses"), F.min("p.proof").alias("low"), F.max("p.proof").alias("high"))
    shared = uses.where("uses > 1").select("table_name", "pair", F.when(F.col("low") == F.col("high"), F.col("uses")).otherwise(F.raise_error(F.lit("two pairs have one name"))).alias("uses"))
    shared = cut(shared)
    buckets = max(16, shared.count() // NUMBERED)
    spread = shared.withColumn("bucket", F.pmod(F.xxhash64("pair"), F.lit(buckets)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = spread.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("pair", "table_name")
    numbered = spread.withColumn("at", F.row_number().over(inside)).join(F.broadcast(offsets), "bucket")
    return numbered.select("table_name", "pair", (F.col("offset") + F.col("at")).alias("number"), "uses")


def integer_tuples(records: DataFrame) -> DataFrame:
    """(table_name, record_no, item_key, record): the records all of whose pairs are in the dictionary, as sorted arrays
    of the pairs' numbers, of any length. The other records have a pair of their own, so they have no copy.

    ``records`` (RECORDS and table_name, record_no) is read twice, so pass it cut. Pairs of very many records meet the
    dictionary by broadcast (fewer than 512 by construction), the rest in a shuffle join; then a record's numbers are
    gathered by its own number."""
    leaves = records.select("table_name", "record_no", "item_key", F.size("pairs").alias("n"), F.explode("pairs.pair").alias("pair"))
    numbered = join_one_sided_hot(leaves, cut(dictionary(records)), ["table_name", "pair"], "inner", "uses")
    gathered = numbered.groupBy("table_name", "record_no").agg(F.first("item_key").alias("item_key"), F.first("n").alias("n"), F.sort_array(F.collect_list("number")).alias("record"))
    return gathered.where(F.size("record") == F.col("n")).select("table_name", "record_no", "item_key", "record")


def numbered_records(parts: dict[str, DataFrame]) -> DataFrame:
    """The records of several tables with table_name and record_no, which tells repeated rows apart; stored."""
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("table_name"), "item_key", "pairs")
        out = part if out is None else out.unionByName(part)
    return cut(out.withColumn("record_no", F.monotonically_increasing_id()))


def copy_groups(tuples: DataFrame) -> DataFrame:
    """One row per distinct tuple of each table: its smallest key (by code point) and the number of copies."""
    return tuples.groupBy("table_name", "record").agg(F.min("item_key").alias("kept_key"), F.count("*").alias("copies"))


def copies_of(records: DataFrame) -> DataFrame:
    """(table_name, kept_key, copy_key) for every member of a group of equal records but the kept one.

    Rows that repeat the kept key give none, other repeated rows give one row each; an empty table gives none. Groups
    with one member are dropped before the join; a group with more than 1/512 of all rows is joined by broadcast, so no
    group ends up in one task."""
    tuples = cut(integer_tuples(records))
    groups = copy_groups(tuples).where(F.col("copies") > 1)
    joined = join_one_sided_hot(tuples, cut(groups), ["table_name", "record"], "inner", "copies")
    return joined.where(F.col("item_key") != F.col("kept_key")).select("table_name", "kept_key", F.col("item_key").alias("copy_key"))


def distinct_records(records: DataFrame) -> DataFrame:
    """(table_name, kept_key, copies): every distinct record once, with its number of copies."""
    tuples = cut(integer_tuples(records))
    alone = records.join(tuples.select("record_no"), "record_no", "left_anti").select("table_name", F.col("item_key").alias("kept_key"), F.lit(1).cast("bigint").alias("copies"))
    return copy_groups(tuples).select("table_name", "kept_key", "copies").unionByName(alone)
