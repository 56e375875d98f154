"""Sentence units of texts in many scripts.

Candidate boundaries (closing marks with what closes with them, and spaces in Thai) are classified by a maximum-entropy
model over the neighbouring tokens, case, length, digits, script and whether the mark stands inside a quotation, a
bracket, a number or an address. The model decides every candidate. It is trained on reliable boundaries of a bounded
sample of the texts: places that the neighbouring characters decide beyond doubt.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sampling import hash_sample

UNITS = "sent_no int, char_start int, char_end int"
#: Texts that the model is trained on at most, characters of a longer one, candidates used of them at most; steps of the fit.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_CANDIDATES, STEPS, RATE, PENALTY = 3_000, 20_000, 60_000, 600, 0.1, 0.01
#: A neighbouring word is a feature of its own from so many occurrences in the sample on; letters of it that are looked at.
WORD_OCCURS, WORD_LETTERS = 3, 40

# Abbreviations, by how they stand in a sentence.
BEFORE_NAMES = frozenset(
    "ee uu dr drs mr mrs ms mme mlle mm m prof st ste mt sr sra srta dra d dña don hr fr frau lic ing rev hon gen col maj capt lt sgt gov sen rep pres supt messrs проф г-н г-жа ак акад им ул пр д-р डॉ श्री".split()
)
BEFORE_FIGURES = frozenset(
    "no nos nr vol vols fig figs p pp pg sec secs ch chap art arts para bd abs kap ziff s seite pág págs núm cap stand str стр с п рис табл гл тел № c ca approx env aprox est geb b born née cf vgl см ср".split()
)
INSIDE = frozenset("vs v i.e e.g z b u a d h t e т е т.е т.д др и ex p.ex cf vgl см incl excl inkl exkl bzw evtl ggf sog bes usu esp resp approx ca env aprox circa jan feb mar apr jun jul aug sept sep oct nov dec viz мин тыс млн млрд руб".split())
MAY_END = frozenset("co inc ltd corp llc bros jr etc al a.m p.m am pm ff f usw u.s u.k u.n гг г века до кв кг км".split())
# Words that follow a time or a number without starting a sentence.
CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december et gmt utc est pst cet januar februar märz mai juni juli oktober dezember".split()
)
_MARK = re.compile(r"[.!?…。！？｡।॥؟۔‼⁇⁈⁉]+")
_BREAK = re.compile("[^\\n\\r\\v\\f\\x1c-\\x1e\\x85\\u2028\\u2029]+")
_PROTECTED = re.compile(r"(?:https?://|www\.)[^\s<>\"”»]*[\w/=&%#-]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b[\w-]{2,}(?:\.[\w-]{2,})*\.(?:com|org|net|gov|edu|example|html|pdf|io|de|fr|es|ru|cn|jp)\b(?:/[^\s<>\"”»]*[\w/])?", re.I)
_QUOTE = re.compile(r"``|''|-LRB-|-RRB-|-LSB-|-RSB-|[\"“”„«»「」『』()\[\]（）《》【】]")
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "《": "》", "【": "】", "``": "''", "-LRB-": "-RRB-", "-LSB-": "-RSB-"}
_CLOSE = frozenset(_OPEN.values())
_BRACKETS = frozenset("()[]（）") | {"-LRB-", "-RRB-", "-LSB-", "-RSB-"}
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile("(?<=\\S)[ \\t\\u00a0]+(?=\\S)")
_WORD_BEFORE = re.compile(r"[^\s\"“”„«»「」『』()\[\]（）,;:…!?]+$")
_WORD_AFTER = re.compile(r"[\w'’.-]+")
_COUNTED = re.compile(r"(?:^|(\w+\.) ?)\d+ ?$")
_TRAIL = ",;:-–—)]}»”’,，、；：）」』%"


def paired(line: str) -> list[tuple[int, int, bool]]:
    """(start, end, bracket) of the outermost quotations and brackets of a line, in order."""
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(line):
        mark, a, b = m.group(), m.start(), m.end()
        before = line[a - 1] if a else " "
        after = line[b] if b < len(line) else " "
        wanted = [c for c, _ in stack]
        if mark == '"':
            alone = before.isspace() and after.isspace()
            closes = '"' in wanted and (alone or not before.isspace() or after.isspace())
            if not closes and not (alone or (not after.isspace() and (before.isspace() or not before.isalnum()))):
                continue
            opens = not closes
        else:
            closes = mark in wanted
            opens = not closes and mark in _OPEN
        if closes:
            while stack:
                close, start = stack.pop()
                if close == mark:
                    while out and out[-1][0] > start:
                        out.pop()
                    out.append((start, b, mark in _BRACKETS))
                    break
        elif opens:
            stack.append((_OPEN.get(mark, '"'), a))
    return out


def _script(c: str) -> str:
    if c.isascii():
        return "latin"
    name = unicodedata.name(c, "")
    return next((s for s in ("CJK", "HIRAGANA", "KATAKANA", "THAI", "DEVANAGARI", "ARABIC", "CYRILLIC") if name.startswith(s)), "latin" if c.isalpha() else "other")


def _char_kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        return "lower"
    if c.isalpha():
        return "caseless"
    if c in "\"“„«「『([（《【`":
        return "opening"
    if c in _TRAIL:
        return "trailing"
    return "symbol"


def _token_class(token: str) -> str:
    low = token.rstrip(".").lower()
    if low in MAY_END:
        return "may_end"
    if low in BEFORE_NAMES:
        return "before_names"
    if low in BEFORE_FIGURES:
        return "before_figures"
    if low in INSIDE:
        return "inside"
    if len(low) == 1 and low.isalpha():
        return "initial"
    if "." in low and all(len(x) <= 2 for x in low.split(".")):
        return "dotted"
    return "number" if low[:1].isdigit() else "word"


class Shape(NamedTuple):
    """What a place looks like, apart from the words next to it."""

    sort: str  # of the mark
    place: str  # inside a pair, an address, a number, or nowhere special
    cls: str  # class of the word before
    size: int  # its length, up to 5
    script: str
    kind: str  # of the character after
    gap: bool  # white space after the mark
    spaced: bool  # white space before it
    quote: str  # what closes with the mark: nothing, a quotation that began the unit, another one
    cased: bool  # the line has capitals
    next_cls: str
    calendar: bool  # the word after is a day, month or time zone
    counted: str  # a number before the mark: at the start of the line, after a word for figures, after another
    capitalised: bool  # the letter after next is small

    def features(self) -> tuple[list[str], list[str], list[str]]:
        """Features of the mark and what is before it, of what comes after, and of several things at once. In training the
        last two parts are left out of some rows, so that each part is learned for itself too."""
        x = self
        before = [
            f"m={x.sort}", f"in={x.place}", f"c={x.cls}", f"l={x.size}", f"s={x.script}", f"sp={x.spaced}", f"gap={x.gap}|{x.sort}", f"ms={x.sort}|{x.script}", f"cs={x.cls}|{x.spaced}",
            f"num={x.counted}",
        ]
        after = [f"k={x.kind}", f"kc={x.kind}|{x.cased}"]
        joint = [
            f"nc={x.next_cls}|{x.cls}", f"cal={x.calendar}|{x.cls}", f"ck={x.cls}|{x.kind}", f"mk={x.sort}|{x.kind}", f"q={x.quote}|{x.kind}|{x.script == 'latin'}",
            f"gk={x.gap}|{x.sort}|{x.kind}|{min(x.size, 3)}|{x.cls == 'word'}|{x.capitalised}", f"nk={x.counted}|{x.kind}", "all=" + "|".join(map(str, x)),
        ]
        return before, after, joint


class Candidate:
    """A place where a unit may end: offset after the closing mark and its closers, how it looks, the words next to it,
    and whether its neighbours decide it beyond doubt (used in training only)."""

    __slots__ = ("certain", "end", "next_word", "shape", "word")

    def __init__(self, end: int, shape: Shape, word: str, next_word: str, certain: bool | None) -> None:
        self.end, self.shape, self.word, self.next_word, self.certain = end, shape, word, next_word, certain


def candidates(line: str) -> Iterator[Candidate]:
    pairs = paired(line)
    starts = [p[0] for p in pairs]
    guarded = [(m.start(), m.end()) for m in _PROTECTED.finditer(line)] if "." in line else []
    guard_starts = [g[0] for g in guarded]
    cased = any(c.isupper() for c in line)
    done = -1  # end of a pair that closes with a mark before
    for m in _MARK.finditer(line):
        a, b = m.span()
        if a < done:
            continue
        mark = m.group()
        before = line[a - 1] if a else ""
        after = line[b] if b < len(line) else ""
        place = ""
        k = bisect_right(guard_starts, a) - 1
        if k >= 0 and a < guarded[k][1]:
            place = "address"
        elif mark == "." and after.isdigit() and (before.isdigit() or not before or before.isspace()):
            place = "number"
        k = bisect_right(starts, a) - 1
        quote = pairs[k] if k >= 0 and a < pairs[k][1] else None
        end = b
        if quote and not place:
            rest = line[b : quote[1]]
            if rest.strip() and _QUOTE.sub("", rest).strip():
                place, quote = "pair", None
            else:
                end = done = quote[1]
        # Closers that stand right after the mark, also of pairs that began before and, in tokenised text, set apart.
        while not place and end < len(line) and line[end] in "”’»」』）)]\"'" and not (line[end] in "\"'" and end + 1 < len(line) and line[end + 1].isalnum()):
            end += 1
        follow = end
        while follow < len(line) and line[follow].isspace():
            follow += 1
        nxt = line[follow] if follow < len(line) else ""
        gap = follow > end
        kind = "opening" if line.startswith(("-LRB-", "-LSB-"), follow) else _char_kind(nxt)
        if kind == "trailing":
            continue  # a comma, colon, dash or closer goes on with the sentence: the mark closes nothing
        last = a
        while last and line[last - 1].isspace():
            last -= 1
        word = _WORD_BEFORE.search(line[max(0, last - WORD_LETTERS) : last]) if last else None
        token = re.split("['\u2019]", word.group().lstrip("'’-–—*#"))[-1] if word else ""
        spaced = bool(before) and before.isspace()
        nw = _WORD_AFTER.match(line, follow, follow + WORD_LETTERS)
        next_word = nw.group().lower().rstrip(".") if nw else ""
        sort = "dots" if "…" in mark or ".." in mark else "stop" if mark == "." else "wide" if mark[-1] in "。！？｡।॥؟۔" else "ask"
        cls = "word" if sort != "stop" or spaced and sort == "stop" and len(token) > 1 and token[-1:] != "." else _token_class(token) if token else "none"
        script = _script(token[-1]) if token else _script(before or nxt or "a")
        calendar, capitalised, counted = next_word in CALENDAR, line[follow + 1 : follow + 2].islower(), ""
        if sort == "stop" and cls == "number" and (found := _COUNTED.search(line, max(0, a - WORD_LETTERS), a)):
            counted = "first" if not found.group(1) else "figures" if found.group(1).rstrip(".").lower() in BEFORE_FIGURES else "other"
        closes = ""
        if quote:
            lead = line[: quote[0]].rstrip()
            closes = "led" if not lead or lead[-1] in "。！？.!?।؟…”」』»\"" or (lead[-1] not in ":：,،，" and not lead[-1].isalnum()) else "held"
        # What is certain.
        certain: bool | None = None
        if place:
            certain = False
        elif kind == "end":
            certain = True
        elif kind == "lower" and cased:
            certain = False
        elif quote and kind == "caseless":
            certain = closes == "held"
        elif quote and kind == "opening" and script != "latin":
            certain = True
        elif sort == "dots" and script in ("CJK", "HIRAGANA", "KATAKANA"):
            certain = False
        elif sort == "wide":
            certain = True
        elif script == "THAI" or (script == "DEVANAGARI" and sort == "stop"):
            certain = False
        elif not gap and sort == "stop" and not quote:
            certain = False if kind != "upper" or cls != "word" or len(token) < 3 or not capitalised else None
        elif sort == "stop" and cls in ("before_names", "initial") and not spaced:
            certain = False
        elif sort == "stop" and cls in ("before_figures", "inside") and kind == "digit":
            certain = False
        elif sort == "stop" and calendar and cls in ("number", "may_end", "dotted"):
            certain = False
        elif sort == "stop" and cls == "may_end" and kind == "upper" and gap:
            certain = True
        elif counted and kind == "upper" and gap:
            certain = {"first": False, "figures": True}.get(counted)
        elif cls == "word" and len(token) >= 4 and kind == "upper" and gap and sort in ("stop", "ask") and not quote:
            certain = True
        shape = Shape(sort, place, cls, min(len(token), 5), script, kind, gap, spaced, closes, cased, _token_class(next_word) if next_word else "none", calendar, counted, capitalised)
        yield Candidate(end, shape, token[-12:].lower(), next_word[:12], certain)
    if _THAI.search(line):
        for m in _THAI_GAP.finditer(line):
            left, right = line[m.start() - 1], line[m.end()]
            if not (_THAI.match(left) or _THAI.match(right)):
                continue
            k = bisect_right(starts, m.start()) - 1
            place = "pair" if k >= 0 and m.start() < pairs[k][1] else "number" if left.isnumeric() or right.isnumeric() else ""
            shape = Shape("space", place, "none", 0, "THAI", _char_kind(right), True, False, "", cased, "none", False, "", False)
            yield Candidate(m.start(), shape, "", "", not place)


class SentenceModel:
    """Weights by feature; unknown features count nothing."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.by_shape: dict[Shape, float] = {}

    def ends(self, c: Candidate) -> bool:
        get = self.weights.get
        score = self.by_shape.get(c.shape)
        if score is None:
            score = self.by_shape[c.shape] = get("bias", 0.0) + sum(get(f, 0.0) for part in c.shape.features() for f in part)
        return score + get("w=" + c.word, 0.0) + get("n=" + c.next_word, 0.0) > 0

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the units, in order, without the white space between them."""
        out = []
        for line in _BREAK.finditer(text):
            start, base, body = 0, line.start(), line.group()
            for end in sorted({c.end for c in candidates(body) if self.ends(c)} | {len(body)}):
                piece = body[start:end]
                left = piece.lstrip()
                if left:
                    first = start + len(piece) - len(left)
                    out.append((base + first, base + first + len(left.rstrip())))
                start = end
        return out


def fit_maxent(rows: Counter) -> SentenceModel:
    """Binary maximum entropy (logistic) by gradient steps on the penalised log likelihood. ``rows`` counts (features,
    label)."""
    number: dict[str, int] = {"bias": 0}
    owner, feature = [], []
    for i, (features, _) in enumerate(rows):
        for f in ("bias", *features):
            owner.append(i)
            feature.append(number.setdefault(f, len(number)))
    owner_, feature_ = np.array(owner, np.int64), np.array(feature, np.int64)
    target, times = np.array([label for _, label in rows], np.float64), np.array(list(rows.values()), np.float64)
    w, first, second = np.zeros(len(number)), np.zeros(len(number)), np.zeros(len(number))
    for step in range(1, STEPS + 1):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(owner_, w[feature_], minlength=len(rows)), -40, 40)))
        slope = (np.bincount(feature_, (times * (chance - target))[owner_], minlength=len(w)) + PENALTY * w) / max(times.sum(), 1)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return SentenceModel({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4})


def reliable_rows(texts: list[str]) -> Counter:
    """How often each (features, label) occurs among places that are certain: once with all features, once without the
    joint ones and once with neither those nor the ones of what follows, a third each."""
    found: Counter = Counter()
    for text in texts:
        for line in _BREAK.finditer(text):
            for c in candidates(line.group()):
                if c.certain is not None:
                    found[c.shape, c.word, c.next_word, c.certain] += 1
        if found.total() >= SAMPLE_CANDIDATES:
            break
    words, next_words = Counter(), Counter()
    for (_, word, next_word, _), n in found.items():
        words[word] += n
        next_words[next_word] += n
    rows: Counter = Counter()
    for (shape, word, next_word, label), n in found.items():
        before, after, joint = shape.features()
        before += [f"w={word}"] * (words[word] >= WORD_OCCURS) + [f"n={next_word}"] * (next_words[next_word] >= WORD_OCCURS)
        for features in (before, before + after, before + after + joint):
            rows[tuple(features), label] += n / 3
    return rows


def fit_on(texts: DataFrame, key: str = "item_key", text: str = "text") -> SentenceModel:
    """The model from at most SAMPLE_TEXTS texts, picked by hash. The units are then found in all texts alike."""
    return fit_maxent(reliable_rows(hash_sample(texts, key, text, SAMPLE_TEXTS, SAMPLE_CHARS)))


def sentence_units(texts: DataFrame, model: SentenceModel, text: str = "text") -> DataFrame:
    """One row per unit with the other columns of ``texts``, sent_no, char_start and char_end (Unicode characters).

    Null texts and texts of white space give none; repeated rows give repeated units; quotations and brackets are paired
    within their line, whatever their length. Other columns must not be called
    like the three new ones. The model is bounded by its training sample and goes out in a broadcast. No shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(model.weights)
    at = texts.columns.index(text)
    kept = [f for i, f in enumerate(texts.schema) if i != at]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), UNITS])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentenceModel(shared.value)
        for batch in batches:
            row, no, start, end = [], [], [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                for k, (a, b) in enumerate(model.units(t) if t else ()):
                    row.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(b)
            index = pa.array(row, pa.int64())
            columns = [c.take(index) for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in (no, start, end))], names=[*names, "sent_no", "char_start", "char_end"])

    return texts.mapInArrow(split, schema)
