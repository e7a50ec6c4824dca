"""Personal data: e-mail addresses, IP addresses, card and phone numbers, also where they are disguised.

Transducers rewrite a text step by step: look-alike characters to ASCII, bracketed and escaped ``at`` and ``dot``, spelled digits, and
``at`` and ``dot`` as plain words where the rest of an address is around them.  Each step keeps what piece of its input each piece
of its output is from.  The detectors run over the text itself and over what the last step gives; spans of the latter are led
back through all steps to characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, pieces, texts_of

# Fixed value: the kinds in the order in which spans of one start are named.
KINDS = ("email", "ip", "card", "phone")
_PLACE = {k: i for i, k in enumerate(KINDS)}
_PIECE_BYTES = 4 << 20

# Letters and signs that look like ASCII ones and that compatibility forms do not tell.
_LOOK_ALIKES = {
    "АВЕКМНОРСТУХЅІЈԌԚԜ": "ABEKMHOPCTYXSIJGQW",
    "аеорсухѕіјԁһԛԝӏ": "aeopcyxsijdhqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αικνορυχ": "aiknopux",
    "օսհոցɑɡıɩ": "ouhngagii",
    "‐‑‒–—―−": "-------",
    "。·‧∙⋅•": "......",
}
_SAME = {a: b for odd, plain in _LOOK_ALIKES.items() for a, b in zip(odd, plain)}
# Digits as words.
_DIGITS = (
    ("0", "zero oh null nil zéro cero"),
    ("1", "one eins un uno"),
    ("2", "two zwei zwo deux dos due"),
    ("3", "three drei trois tres tre"),
    ("4", "four vier quatre cuatro quattro"),
    ("5", "five fünf cinq cinco cinque"),
    ("6", "six sechs seis sei"),
    ("7", "seven sieben sept siete sette"),
    ("8", "eight acht huit ocho otto"),
    ("9", "nine neun neuf nueve nove"),
)
_DIGIT_OF = {w: d for d, words in _DIGITS for w in words.split()}
_TIMES = {"double": 2, "triple": 3}
_PLUS = "plus"
_COUNTING = {*_DIGIT_OF, *_TIMES, _PLUS}
_DOT_NAMES = {"dot", "punkt", "point", "punto", "ponto"}

_WORDS = "|".join(sorted([*_DIGIT_OF, *_TIMES, _PLUS], key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_WORDS})\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_BETWEEN = re.compile(r"[\s,-]{1,3}")
_LEET = re.compile(r"(?<![^\W_])(?=[OoIl]*[0-9])[0-9OoIl]{2,}(?![^\W_])")
_LEET_DIGITS = str.maketrans("OoIl", "0011")

_AT, _DOT = r"(?:at|arroba|chez)", rf"(?:{'|'.join(sorted(_DOT_NAMES))})"
_BRACKETED = re.compile(
    rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:({_AT}|ät|@)|({_DOT}|\.))\s{{0,3}}[\])}}>]\s{{0,3}}"
    r"|(&#0{0,4}64;|&#x0{0,4}40;|&commat;|%40)|(&#0{0,4}46;|&#x0{0,4}2e;|&period;|%2e)",
    re.I,
)
_DOT_WORD = rf"\s{{1,3}}{_DOT}\s{{1,3}}"
_LOCAL = r"[A-Za-z0-9_%+-]++"
_PLAIN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])({_LOCAL}(?:(?:{_DOT_WORD}|\.){_LOCAL})*+)"
    rf"(\s{{0,3}}@\s{{0,3}}|\s{{1,3}}{_AT}\s{{1,3}})"
    rf"([A-Za-z0-9-]++(?:(?:{_DOT_WORD}|\.)[A-Za-z0-9-]++)++)",
    re.I,
)
_DOTS = re.compile(_DOT_WORD, re.I)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT_WORD}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DOT_ALONE = re.compile(rf"\b{_DOT}\b", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOP = re.compile(r"[A-Za-z]{2,}")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Led by the ``@``: what is before it up to the match before, then a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        # The longest run that ends at the sign, found from its reverse.
        low = at
        while low > end:
            some = text[max(end, low - 64) : low][::-1]
            run = _LOCAL_END.match(some).end()
            low -= run
            if run < len(some):
                break
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            end = found.end()
            yield low, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield m.span()


_DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers as they stand, leftmost first and without overlaps in each kind."""
    return [(kind, *span) for kind, run in _DETECTORS.items() for span in run(text)]


class Rewritten:
    """A text after edits (start, end, replacement) in order, and the way back to the positions before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self._outs: list[int] = []
        self._marks: list[tuple[int, int, bool]] = []
        parts, at, out = [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for piece, mark in ((text[at:start], (at, start, False)), (new, (start, end, True))):
                if piece:
                    self._outs.append(out)
                    self._marks.append(mark)
                    parts.append(piece)
                    out += len(piece)
            at = end
        self.text = "".join(parts)

    def _from(self, position: int) -> Span:
        i = bisect_right(self._outs, position) - 1
        start, end, edited = self._marks[i]
        if edited:
            return start, end
        place = start + position - self._outs[i]
        return place, place + 1

    def back(self, span: Span) -> Span:
        """The span of the text before that gave the non-empty ``span``."""
        return self._from(span[0])[0], self._from(span[1] - 1)[1]


@lru_cache(maxsize=1 << 16)
def _ascii(char: str) -> str | None:
    """The ASCII character a character looks like, an empty text if it cannot be seen, None if it stays."""
    if char in _SAME:
        return _SAME[char]
    if unicodedata.category(char) == "Cf":
        return ""
    if (digit := unicodedata.decimal(char, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else None


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = {c: new for c in set(text) if not c.isascii() and (new := _ascii(c)) is not None}
    if not odd:
        return []
    return [(m.start(), m.end(), odd[m[0]]) for m in re.finditer(f"[{''.join(map(re.escape, odd))}]", text)]


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    if not any(c in text for c in "[({<&%"):
        return []
    return [(*m.span(), "@" if m[1] or m[3] else ".") for m in _BRACKETED.finditer(text)]


def _side_by_side(text: str) -> bool:
    """Whether two words for digits follow each other, or stand on two sides of a ``dot``; most texts end here."""
    words = _WORD.findall(text.lower())
    at = [i for i, w in enumerate(words) if w in _COUNTING]
    if any(words[i] == _PLUS and words[i + 1 : i + 2] and words[i + 1].isdigit() for i in at):
        return True
    return any(b - a == 1 or b - a == 2 and words[a + 1] in _DOT_NAMES for a, b in zip(at, at[1:]))


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Words for digits become digits, those next to each other without what is between; letters among digits too.

    A single such word is left as it is, as one may follow a number by chance, but for a plus in front of a number.
    """
    runs: list[list[tuple[re.Match, bool]]] = []
    if _side_by_side(text):
        for m in _SPELLED.finditer(text):
            end = runs[-1][-1][0].end() if runs else 0
            touching = runs and m.start() - end <= 3 and _BETWEEN.fullmatch(text, end, m.start())
            if touching or runs and m.start() - end <= 14 and _DOTS.fullmatch(text, end, m.start()):
                runs[-1].append((m, bool(touching)))
            else:
                runs.append([(m, False)])
    edits = []
    for run in runs:
        times = 1
        for i, (m, touching) in enumerate(run):
            word, (start, end) = m[0].lower(), m.span()
            if len(run) == 1 and not (word == _PLUS and text[end + 1 : end + 2].isdigit()):
                continue
            if touching:
                edits.append((run[i - 1][0].end(), start, ""))
            if word == _PLUS and text[end : end + 1] == " " and text[end + 1 : end + 2].isdigit():
                end += 1
            edits.append((start, end, "+" if word == _PLUS else "" if word in _TIMES else _DIGIT_OF[word] * times))
            times = _TIMES.get(word, 1)
    for m in _LEET.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 2 * digits >= len(m[0]) > digits:
            edits.extend((m.start() + i, m.start() + i + 1, c.translate(_LEET_DIGITS)) for i, c in enumerate(m[0]) if c in "OoIl")
    return sorted(edits)


def _plain(text: str) -> list[tuple[int, int, str]]:
    """``at`` and ``dot`` as words, and spaces around the sign, inside what is an address with them."""
    edits = []
    dotted = bool(_DOT_ALONE.search(text))
    if not dotted and "@" not in text:
        return edits
    for m in _PLAIN.finditer(text):
        by_word = "@" not in m[2]
        top = re.split(rf"{_DOT_WORD}|\.", m[3], flags=re.I)[-1]
        if by_word and not _DOTS.search(m[3]) or not _TOP.fullmatch(top):
            continue
        edits.extend((*d.span(), ".") for d in _DOTS.finditer(text, *m.span(1)))
        if m[2] != "@":
            edits.append((*m.span(2), "@"))
        edits.extend((*d.span(), ".") for d in _DOTS.finditer(text, *m.span(3)))
    if dotted:
        for m in _DOTTED.finditer(text):
            edits.extend((*d.span(), ".") for d in _DOTS.finditer(text, *m.span()))
    return sorted(set(edits))


TRANSDUCERS = (_look_alikes, _bracketed, _spelled, _plain)


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, value) by start, then kind: what stands in the text, and what its rewriting shows.

    A find of the rewriting is left out if a base span of its kind covers it, and a name whose last label is no word of letters.
    """
    base = detect(text)
    steps, now = [], text
    for run in TRANSDUCERS:
        edits = run(now)
        if edits:
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    found = [(kind, start, end, True, text[start:end]) for kind, start, end in base]
    if steps:
        covers: dict[str, tuple[list[int], list[int]]] = {}
        for kind, start, end in base:
            starts, ends = covers.setdefault(kind, ([], []))
            starts.append(start)
            ends.append(end)
        for kind, start, end in detect(now):
            value, span = now[start:end], (start, end)
            for step in reversed(steps):
                span = step.back(span)
            if kind == "email" and not _TOP.fullmatch(value.rpartition(".")[2]):
                continue
            starts, ends = covers.get(kind, ([], []))
            i = bisect_right(starts, span[0]) - 1
            if i < 0 or ends[i] < span[1]:
                found.append((kind, *span, False, value))
    return sorted(set(found), key=lambda s: (s[1], _PLACE[s[0]], s[2]))


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"
_SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
)
_NAMES = ("kind", "start", "end", "base", "value")


def _scan(masked: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts_of(batch.column("text"))
            for start, stop in pieces(np.array([len(t) for t in raw]), _PIECE_BYTES):
                texts = [t.decode("utf-8", "replace") for t in raw[start:stop]]
                spans = [find(t) for t in texts]
                columns = [batch.column("doc_id").slice(start, stop - start)]
                columns.append(pa.array([[dict(zip(_NAMES, s)) for s in found] for found in spans], _SPANS_ARROW))
                if masked:
                    columns.append(pa.array([mask(t, found) for t, found in zip(texts, spans)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])

    return run


def mask(text: str, spans: list[tuple[str, int, int, bool, str]]) -> str:
    """The text with each find replaced by its kind in angle brackets; of overlapping finds the first names the whole."""
    parts, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", masked: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end, base, value), and the masked text if asked for.

    Positions are code points, the end exclusive; ``base`` tells that the text itself has it, ``value`` is the identifier as found, rewritten
    if need be.  A null or empty text has no spans; bytes that are no UTF-8 count as one character each.  Rows that repeat are rows
    of their own; other columns are not read.  An empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = f"doc_id long, spans {_SPANS}" + (", masked string" if masked else "")
    return on_arrow(source, _scan(masked), schema)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans as text, from the spans of ``pii_spans``."""
    base = F.filter("spans", lambda s: s["base"])

    def shown(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return pii_spans(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )
