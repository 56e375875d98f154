"""Vectorised structural index over a batch of JSON documents (Arrow batch in, numpy inside, one task's batch at a time).

Quote, bracket and delimiter bitmaps are taken over the joined bytes of the batch; quote parity gives the in-string
mask, a prefix sum over brackets the nesting depth, and the spans of all values follow from positions and depths.
No character loop runs in Python. Grammar, strings and scalars are checked on the same index, so a body that is not
one whole JSON document (RFC 8259) is marked bad.
"""

from __future__ import annotations

import json
import re

import numpy as np

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR = range(8)
_SCALAR_TEXT = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")

_KIND = np.full(256, -1, np.int8)
for _code, _char in enumerate(b"{}[]:,"):
    _KIND[_char] = _code
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_AFTER_BACKSLASH = np.zeros(256, bool)
_AFTER_BACKSLASH[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class StructuralIndex:
    """Tokens of all documents of a batch, in order.

    ``kind``, ``start``, ``end``, ``doc`` (document number), ``parent`` (token number of the enclosing bracket, -1 at
    the root) and ``valid`` (a flag per document). ``children(t)`` lists the value tokens directly inside bracket t.
    """

    def __init__(self, documents: list[bytes]) -> None:
        self.data = b"\n".join(documents) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        n, count = len(buf), len(documents)
        lengths = np.fromiter((len(d) for d in documents), np.int64, count)
        starts = np.zeros(count + 1, np.int64)
        np.cumsum(lengths + 1, out=starts[1:])
        self.valid = np.ones(count, bool)

        # Escapes: a byte is escaped when an odd run of backslashes ends before it.
        slash = buf == 92
        escaped = np.zeros(n, bool)
        if slash.any():
            places = np.arange(n, dtype=np.int32)
            last_other = np.maximum.accumulate(np.where(slash, np.int32(-1), places))
            run = places - last_other
            escaped[1:] = (run[:-1] & 1).astype(bool)
            del places, last_other, run

        # Quote bitmap and, by parity from each document's start, the in-string mask (opening quote to closing quote).
        quotes = np.flatnonzero((buf == 34) & ~escaped)
        quote_doc = np.searchsorted(starts, quotes, "right") - 1
        per_doc = np.bincount(quote_doc, minlength=count)
        first = np.zeros(count + 1, np.int64)
        np.cumsum(per_doc, out=first[1:])
        self.valid &= per_doc % 2 == 0
        opening = (np.arange(len(quotes)) - first[quote_doc]) % 2 == 0
        whole = self.valid[quote_doc]
        opens, closes = quotes[opening & whole], quotes[~opening & whole]
        mask = np.zeros(n + 1, np.int8)
        mask[opens] += 1
        mask[closes + 1] -= 1
        in_string = np.cumsum(mask, dtype=np.int8)[:n].astype(bool)

        self._check_strings(buf, in_string, slash & ~escaped, starts)

        # Delimiters outside strings, strings and runs of other bytes are the tokens.
        kind_at = _KIND[buf]
        marks = np.flatnonzero((kind_at >= 0) & ~in_string)
        other = ~in_string & (kind_at < 0) & ~_SPACE[buf]
        edge = np.diff(np.concatenate(([0], other.view(np.int8), [0])))
        run_starts, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        start = np.concatenate((marks, opens, run_starts))
        end = np.concatenate((marks + 1, closes + 1, run_ends))
        kind = np.concatenate((kind_at[marks], np.full(len(opens), STRING, np.int8), np.full(len(run_starts), SCALAR, np.int8)))
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.kind = start[order], end[order], kind[order]
        self.doc = np.searchsorted(starts, self.start, "right") - 1
        self._nest(count)
        self._check_grammar(count)
        self._check_scalars()
        self._link()

    def _bad(self, places: np.ndarray, starts: np.ndarray) -> None:
        self.valid[np.searchsorted(starts, places, "right") - 1] = False

    def _check_strings(self, buf: np.ndarray, in_string: np.ndarray, escape: np.ndarray, starts: np.ndarray) -> None:
        self._bad(np.flatnonzero(in_string & (buf < 32)), starts)
        escape = np.flatnonzero(escape)
        if len(escape):
            self._bad(escape[~in_string[escape]], starts)
            after = buf[np.minimum(escape + 1, len(buf) - 1)]
            self._bad(escape[~_AFTER_BACKSLASH[after]], starts)
            unicode = escape[after == 117]
            for k in range(2, 6):
                self._bad(unicode[~_HEX[buf[np.minimum(unicode + k, len(buf) - 1)]]], starts)

    def _nest(self, count: int) -> None:
        """Depth by prefix sums within each document, and the enclosing bracket of every token."""
        kind, doc = self.kind, self.doc
        opener = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY)
        closer = (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        step = opener.astype(np.int32) - closer.astype(np.int32)
        total = np.cumsum(step, dtype=np.int64)
        self.first = np.searchsorted(doc, np.arange(count + 1), "left")
        has = self.first[:-1] < self.first[1:]
        self.valid &= has
        base = np.where(self.first[:-1] > 0, total[np.maximum(self.first[:-1], 1) - 1] if len(total) else 0, 0)
        depth = total - base[doc] if len(total) else total
        if len(total):
            self.valid[np.unique(doc[depth < 0])] = False
            last = depth[np.maximum(self.first[1:], 1) - 1]
            self.valid &= ~has | (last == 0)
        level = depth - opener
        self.level = level
        parent = np.full(len(kind), -1, np.int64)
        partner = np.full(len(kind), -1, np.int64)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2), "left")
        before: np.ndarray | None = None
        for at in range(len(bounds) - 1):  # once a nesting level, over all documents together
            here = order[bounds[at] : bounds[at + 1]]
            if before is not None and len(before):
                where = np.searchsorted(before, here) - 1
                parent[here] = np.where(where >= 0, before[where], -1)
            openers = here[opener[here]]
            closers = here[closer[here]]
            if len(closers) and len(openers):
                where = np.searchsorted(openers, closers) - 1
                partner[closers] = np.where(where >= 0, openers[where], -1)
            before = openers
        foreign = (parent >= 0) & (doc[np.maximum(parent, 0)] != doc)
        self.valid[np.unique(doc[foreign])] = False
        closers = np.flatnonzero(closer)
        wrong = (partner[closers] < 0) | (kind[np.maximum(partner[closers], 0)] != kind[closers] - 1) | (doc[np.maximum(partner[closers], 0)] != doc[closers])
        self.valid[np.unique(doc[closers[wrong]])] = False
        self.parent = parent
        good = closers[~wrong]
        self.close = np.arange(len(kind))
        self.close[partner[good]] = good

    def _check_grammar(self, count: int) -> None:
        """Each token against the next one of its document, by the kind of the bracket around it."""
        kind, parent = self.kind, self.parent
        if not len(kind):
            return
        around = np.where(parent >= 0, kind[np.maximum(parent, 0)], -1)
        following = np.full(len(kind), -1, np.int8)  # -1: the document ends here
        following[:-1] = np.where(self.doc[1:] == self.doc[:-1], kind[1:], -1)
        leading = np.full(len(kind), -1, np.int8)
        leading[1:] = np.where(self.doc[1:] == self.doc[:-1], kind[:-1], -1)
        starts_value = np.isin(following, (OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR))
        self.is_key = key = (kind == STRING) & (around == OPEN_OBJECT) & ((leading == OPEN_OBJECT) | (leading == COMMA))
        ok = np.zeros(len(kind), bool)
        ok |= (kind == OPEN_OBJECT) & ((following == STRING) | (following == CLOSE_OBJECT))
        ok |= (kind == OPEN_ARRAY) & (starts_value | (following == CLOSE_ARRAY))
        ok |= (kind == COLON) & (around == OPEN_OBJECT) & starts_value
        ok |= (kind == COMMA) & (around == OPEN_OBJECT) & (following == STRING)
        ok |= (kind == COMMA) & (around == OPEN_ARRAY) & starts_value
        ok |= key & (following == COLON)
        value = np.isin(kind, (CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR)) & ~key
        ok |= value & (around == OPEN_OBJECT) & ((following == COMMA) | (following == CLOSE_OBJECT))
        ok |= value & (around == OPEN_ARRAY) & ((following == COMMA) | (following == CLOSE_ARRAY))
        ok |= value & (around == -1) & (following == -1)
        # A colon may only follow a key: a second one in a member would.
        ok &= ~((kind == COLON) & ~np.concatenate(([False], key[:-1])))
        self.valid[np.unique(self.doc[~ok])] = False
        filled = self.first[:-1] < self.first[1:]
        head = kind[self.first[:-1][filled]]
        self.valid[np.flatnonzero(filled)[~np.isin(head, (OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR))]] = False

    def _check_scalars(self) -> None:
        known: dict[bytes, bool] = {}
        for t in np.flatnonzero(self.kind == SCALAR):
            text = self.data[self.start[t] : self.end[t]]
            fits = known.get(text)
            if fits is None:
                fits = known[text] = _SCALAR_TEXT.fullmatch(text) is not None
            if not fits:
                self.valid[self.doc[t]] = False

    def _link(self) -> None:
        """Value tokens grouped by their bracket, in order."""
        values = np.flatnonzero(np.isin(self.kind, (OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR)) & ~self.is_key) if len(self.kind) else np.zeros(0, np.int64)
        owner = self.parent[values] if len(self.kind) else values
        order = np.argsort(owner, kind="stable")
        self._values = values[order]
        self._value_first = np.searchsorted(owner[order], np.arange(len(self.kind) + 1), "left")

    def root(self, doc: int) -> int:
        return int(self.first[doc])

    def children(self, token: int) -> np.ndarray:
        return self._values[self._value_first[token] : self._value_first[token + 1]]

    def text(self, token: int) -> str:
        """The JSON text of a value."""
        return self.data[self.start[token] : self.end[self.close[token]]].decode()

    def string(self, token: int) -> str:
        raw = self.data[self.start[token] : self.end[token]]
        return json.loads(raw) if b"\\" in raw else raw[1:-1].decode()

    def member(self, token: int, names: dict[str, str]) -> dict[str, int]:
        """Value tokens of the members of an object whose keys are in ``names``; of repeated keys the last counts."""
        found = {}
        for v in self.children(token):
            key = v - 2
            name = self.string(key)
            if name in names:
                found[names[name]] = int(v)
        return found

    def is_null(self, token: int) -> bool:
        return self.kind[token] == SCALAR and self.data[self.start[token]] == 110
