"""Secret scans: fixed patterns over a text and over everything that can be decoded from it.

A worklist holds layers: the text, then what URL escapes, Unicode escapes, base64 runs and compressed
streams in a layer unwrap to, until nothing new comes out.  A layer seen before is not taken up again.  Layers are taken depth first, as
they are unwrapped, so that of each level one layer, or one window of a stream, is held at a time.
Each layer can tell where in the one above a range of its bytes came from, so a find is reported where it lies in the text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, texts_of

# A compressed stream is scanned in windows of so many bytes, each with the end of the one before.
WINDOW_BYTES = 2 << 20
OVERLAP_BYTES = 1 << 16
MIN_BASE64 = 16

# The patterns of the three kinds, and the least length of what counts.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

_PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_B64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
_IS_B64 = bytes(97 if c in _B64 else 32 for c in range(256))
_IS_HEX = bytes(97 if c in b"0123456789abcdef" else 32 for c in range(256))
_STANDARD = bytes.maketrans(b"-_", b"+/")
# A line break inside wrapped base64, also when written as an escape in a string.
_BREAK = re.compile(rb"(?<=[A-Za-z0-9+/_-])[\x20\t]*(?:\r\n|[\r\n]|(?:\\r)?\\n)[\x20\t]*(?=[A-Za-z0-9+/_-])")
_HIGH_BYTE = re.compile(rb"\\x[89A-Fa-f][0-9A-Fa-f]")
_BYTE_ESCAPE = re.compile(rb"\\(?:x([0-9A-Fa-f]{2})|([abfnrtv0\\'\"]))")
_SIMPLE = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0"))
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
# Bytes that a base64 or hex run, a value or escapes may consist of; what ends in such a run is not finished.
_UNFINISHED = _B64 + b"=.%\\{}\r\n"
# How much of a compressed stream is fed at once, so that the rest is not copied for every try.
_FEED_BYTES = 1 << 16


def _runs(data: bytes, table: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least ``least`` bytes of a class, found by searching a run of that length."""
    marks = data.translate(table)
    needle, at = b"a" * least, 0
    while (start := marks.find(needle, at)) >= 0:
        end = marks.find(b" ", start)
        at = len(data) if end < 0 else end
        yield start, at


def find(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes; leftmost and not overlapping within a kind, short ones dropped."""
    found = []
    low = data.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"apikey" in low or b"api_key" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(data) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(data) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *span) for span in _runs(data, _IS_HEX, MIN_HEX)]
    return found


class _Layer:
    """Bytes, and where in the layer above they came from: ``first`` and ``last`` give begin and end of what made one byte."""

    __slots__ = ("data", "above", "first", "last")

    def __init__(self, data: bytes, above: _Layer | None = None, first: Callable[[int], int] | None = None, last: Callable[[int], int] | None = None):
        self.data, self.above, self.first, self.last = data, above, first, last

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The range of the text that gave the bytes start .. end."""
        layer = self
        while layer.above is not None:
            start, end = layer.first(start), layer.last(end - 1)
            layer = layer.above
        return start, end


def _lines_with(data: bytes, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    while m := pattern.search(data, at):
        start = data.rfind(b"\n", 0, m.start()) + 1
        end = data.find(b"\n", m.end())
        at = len(data) if end < 0 else end
        yield start, at


def _code_points(units: list[tuple[int, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """UTF-8 of (code, start, end), with surrogate pairs joined."""
    i = 0
    while i < len(units):
        code, start, end = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units):
            low, next_start, next_end = units[i + 1]
            if 0xDC00 <= low < 0xE000 and next_start == end:
                code, end, i = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00), next_end, i + 1
        i += 1
        if code < 0x110000:
            yield chr(code).encode("utf-8", "replace"), start, end


def _rewritten(layer: _Layer, first: int, last: int, parts: list[tuple[bytes, int, int]]) -> _Layer:
    """The bytes first .. last of a layer with the ranges of ``parts`` replaced."""
    out, at, size = [], first, 0
    begins, starts, ends = (np.zeros(len(parts), np.int64) for _ in range(3))
    for i, (new, start, end) in enumerate(parts):
        out += [layer.data[at:start], new]
        size += start - at
        begins[i], starts[i], ends[i] = size, start, end
        size += len(new)
        at = end
    out.append(layer.data[at:last])
    lengths = np.array([len(new) for new, _, _ in parts], np.int64)

    def place(i: int) -> tuple[int, int]:
        k = int(np.searchsorted(begins, i, "right")) - 1
        if k < 0:
            return first + i, first + i + 1
        over = i - int(begins[k]) - int(lengths[k])
        return (int(starts[k]), int(ends[k])) if over < 0 else (int(ends[k]) + over, int(ends[k]) + over + 1)

    return _Layer(b"".join(out), layer, lambda i: place(i)[0], lambda i: place(i)[1])


def _percent(layer: _Layer) -> Iterator[_Layer]:
    data = layer.data
    if b"%" not in data:
        return
    for first, last in _lines_with(data, _PERCENT):
        parts = [(bytes([int(m[0][1:], 16)]), *m.span()) for m in _PERCENT.finditer(data, first, last)]
        yield _rewritten(layer, first, last, parts)


def _unicode(layer: _Layer) -> Iterator[_Layer]:
    """Escapes as characters, and if a byte above 127 is escaped as two hex digits, once more with those as bytes."""
    data = layer.data
    if b"\\" not in data:
        return
    for first, last in _lines_with(data, _ESCAPE):
        units = [(int(next(g for g in m.groups() if g), 16), *m.span()) for m in _ESCAPE.finditer(data, first, last)]
        yield _rewritten(layer, first, last, list(_code_points(units)))
    for first, last in _lines_with(data, _HIGH_BYTE):
        parts = [
            (bytes([int(m[1], 16) if m[1] else _SIMPLE.get(m[2][0], m[2][0])]), *m.span())
            for m in _BYTE_ESCAPE.finditer(data, first, last)
        ]
        yield _rewritten(layer, first, last, parts)


def _decoded(layer: _Layer, segments: list[tuple[int, int]]) -> Iterator[_Layer]:
    """A run at its four alignments, so from wherever in it the base64 begins; the run's characters lie in ``segments``."""
    run = b"".join(layer.data[a:b] for a, b in segments).translate(_STANDARD)
    offsets = [0]
    for a, b in segments:
        offsets.append(offsets[-1] + b - a)

    def place(i: int) -> int:
        k = bisect_right(offsets, i) - 1
        return segments[k][0] + i - offsets[k]

    def begin_of(shift: int) -> Callable[[int], int]:
        return lambda i: place(shift + i // 3 * 4 + i % 3)

    def end_of(shift: int) -> Callable[[int], int]:
        return lambda i: place(min(shift + i // 3 * 4 + i % 3 + 1, len(run) - 1)) + 1

    for shift in range(4):
        length = len(run) - shift
        length -= length % 4 == 1
        if length < MIN_BASE64:
            return
        got = binascii.a2b_base64(run[shift : shift + length] + b"=" * (-length % 4))
        yield _Layer(got, layer, begin_of(shift), end_of(shift))


def _base64(layer: _Layer) -> Iterator[_Layer]:
    data = layer.data
    for start, end in _runs(data, _IS_B64, MIN_BASE64):
        yield from _decoded(layer, [(start, end)])
    # Runs that go on behind a line break, each from the first break in it to the last.
    marks, segments = data.translate(_IS_B64), []
    for m in _BREAK.finditer(data):
        if not segments or segments[-1][1] != m.start():
            yield from _of_lines(layer, segments)
            segments = [(marks.rfind(b" ", 0, m.start()) + 1, m.start())]
        end = marks.find(b" ", m.end())
        segments.append((m.end(), len(data) if end < 0 else end))
    yield from _of_lines(layer, segments)


def _of_lines(layer: _Layer, segments: list[tuple[int, int]]) -> Iterator[_Layer]:
    if sum(b - a for a, b in segments) >= MIN_BASE64:
        yield from _decoded(layer, segments)


class _Stream:
    """A compressed stream of ``data`` from ``at``; what was read before an error counts."""

    def __init__(self, data: bytes, at: int):
        self.data, self.end, self.finished, self.failed = data, at, False, False

    def read(self) -> Iterator[bytes]:
        if self.data.startswith(b"BZh", self.end):
            opener = bz2.BZ2Decompressor()
        elif self.data.startswith(b"\xfd7zXZ", self.end):
            opener = lzma.LZMADecompressor()
        else:
            opener = zlib.decompressobj(47)
        try:
            rest = b""
            while not opener.eof:
                if not rest and getattr(opener, "needs_input", True):
                    rest = self.data[self.end : self.end + _FEED_BYTES]
                    self.end += len(rest)
                    if not rest:
                        return
                got = opener.decompress(rest, WINDOW_BYTES)
                rest = getattr(opener, "unconsumed_tail", b"")
                if got:
                    yield got
            self.end -= len(opener.unused_data)
            self.finished = True
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            self.failed = True


def _unfinished(data: bytes) -> int:
    """Where at the end of ``data`` a run or a compressed stream begins that may go on behind it."""
    least = len(data.rstrip(_UNFINISHED))
    at = 0
    while (m := _MAGIC.search(data, at)) and m.start() < least:
        stream = _Stream(data, m.start())
        for _ in stream.read():
            pass
        if not stream.finished and not stream.failed:
            return m.start()
        at = stream.end if stream.finished else m.start() + 1
    return least


def _windows(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Windows of a stream, each with the end of the one before; none ends inside a run or an inner stream."""
    held, new, step, seen = [], 0, WINDOW_BYTES, 0
    for part in parts:
        held.append(part)
        new += len(part)
        if new < step:
            continue
        data = b"".join(held)
        cut, new = _unfinished(data), 0
        if cut > seen:
            yield data[:cut]
            seen = min(cut, OVERLAP_BYTES)
            held, step = [data[cut - seen :]], WINDOW_BYTES
        else:
            held, step = [data], len(data)  # a run that goes on is looked at again when it has doubled
    if held:
        yield b"".join(held)


def _streams(data: bytes, at: int, end: list[int]) -> Iterator[bytes]:
    """What the streams from ``at`` hold that follow each other directly; ``end`` gets how far they were read and are whole."""
    while True:
        stream = _Stream(data, at)
        for part in stream.read():
            end[0] = stream.end
            yield part
        if stream.finished:
            end[:] = [stream.end, stream.end]
        if not stream.finished or not _MAGIC.match(data, stream.end):
            return
        at = stream.end


def _compressed(layer: _Layer) -> Iterator[_Layer]:
    """What compressed streams anywhere in a layer hold, window by window."""
    data, at = layer.data, 0
    while m := _MAGIC.search(data, at):
        end = [m.start() + 1] * 2
        for got in _windows(_streams(data, m.start(), end)):
            yield _Layer(got, layer, lambda _, first=m.start(): first, lambda _, last=end[0]: last)
        at = end[1]


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    for unwrap in (_percent, _unicode, _base64, _compressed):
        yield from unwrap(layer)


def scan(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base finds and all finds, as sorted (start, kind number, end) in code points."""

    def ordered(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if text.isascii():
            return sorted(spans)
        place = {at: len(text[:at].decode("utf-8", "replace")) for s in spans for at in (s[0], s[2])}
        return sorted((place[a], k, place[b]) for a, k, b in spans)

    base = {(start, KINDS.index(kind), end) for kind, start, end in find(text)}
    spans, seen, work = set(base), set(), [_unwrapped(_Layer(text))]
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        if not below.data:
            continue
        known = (hashlib.blake2b(below.data, digest_size=16).digest(), below.origin(0, len(below.data)))
        if known in seen:
            continue
        seen.add(known)
        for kind, start, end in find(below.data):
            first, last = below.origin(start, end)
            spans.add((first, KINDS.index(kind), last))
        work.append(_unwrapped(below))
    return ordered(base), ordered(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts_of(batch.column("text")):
            base, spans = scan(text)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base finds, and all spans, of every row of ``docs``.

    Counts and base_sha256 are of the text itself; spans holds those and the finds of decoded layers, mapped back.
    Null texts count as empty: no spans, the digest of an empty string.  Repeated rows and null identifiers
    are rows of their own; an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return on_arrow(source, _run, _SCHEMA)
