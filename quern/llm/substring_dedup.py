"""Suffix-array dedup: remove bytes covered by a 50-byte string that also starts in an earlier document.

Every 50-byte window has an anchor, the 16 bytes in it with the least hash, so equal windows have equal
anchors.  Documents lie in blocks; a block tells which anchors it holds, and learns which of them another document
holds too.  Only around those the bytes go on, dealt by anchor, as pieces that join the windows of one anchor.
A block sends each piece once, with its least document, and keeps where the piece lies, so a passage of many documents is one piece a block.
What a part gets is packed in shares, of which only one is open at a time.  Equal pieces are one.  Where an anchor has different pieces, their suffixes are sorted by grouping, and windows that
are equal lie side by side in that order, so the least document of each is known.  The blocks get each piece's least document of all
back, and for that one the windows that also lie in another piece of an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import let_go_but, on_arrow, pieces, shuffle_parts, text_runs
from quern.llm.grouping_sa import suffix_array
from quern.llm.quality import _mixed, _power

WINDOW = 50
GRAM = 16
# An anchor that occurs more often than this has its windows dealt one by one, not as pieces.
HOT_DOCUMENTS = 2_000
# Bytes of text that a block holds on average at most; where the shuffle has fewer partitions, a partition has several blocks.
BLOCK_BYTES = 24 << 20
# Bytes of pieces whose suffixes are sorted at once; the pieces of an anchor stay together.
SORT_BYTES = 1 << 17

_SPAN = WINDOW - GRAM + 1
_CHUNK = 1 << 18
_OUT_BYTES = 1 << 22
_SHARES = 8
_PLACE = np.uint64((1 << 20) - 1)
_HASH = np.uint64((1 << 48) - 1)
_HOT = np.uint64(1 << 63)
_NO_ID = np.iinfo(np.int64).max
_NO_SIDE = 255
_SEVERAL = np.uint16(1 << 15)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@lru_cache
def _zip() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def _packed(*arrays: np.ndarray, rest: bytes = b"") -> bytes:
    """Arrays and bytes as one compressed frame."""
    head = np.array([len(a) for a in arrays] + [len(rest)], "<u8").tobytes()
    return _zip().compress(head + b"".join(a.tobytes() for a in arrays) + rest)


def _unpacked(raw, *kinds: str) -> list:
    data = zstandard.ZstdDecompressor().decompress(raw)
    sizes = np.frombuffer(data, "<u8", len(kinds) + 1).tolist()
    at, out = 8 * len(sizes), []
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, memoryview(data)[at:]]


def _buffers(table: pa.Table, name: str) -> Iterator[pa.Buffer]:
    """The values of a binary column, not copied."""
    return (value.as_buffer() for value in table.column(name))


class _Runs:
    """Anchors of some texts: for each, its text, the first and last window it stands for, its place and hash."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, at: int):
        """``doc`` numbers the text of each byte, ``at`` is where in all texts ``data`` begins."""
        n = len(data)
        h = (data.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]
        for step, factor in zip((1, 2, 4, 8), _FACTORS[1:]):
            h[:-step] = h[:-step] * factor + h[step:]  # of 2, 4, 8, 16 bytes; the last ones are never used
        self.gram = h = _mixed(h[: n - GRAM + 1])
        least = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        width = 1
        while width * 2 <= _SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])
        place = (_PLACE - (least & _PLACE)).astype(np.int64)
        valid = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        end = np.ones(len(place), bool)
        end[:-1] = new[1:] | ~valid[1:]
        self.first, self.last = np.flatnonzero(new & valid), np.flatnonzero(end & valid)
        self.place = place[self.first]
        self.doc = doc[self.first]
        self.hash = h[self.place] & _HASH
        self.data, self.at = data, at


def _runs(texts: list[bytes]) -> Iterator[_Runs]:
    """The anchors of texts, some texts or a part of a long one at a time."""
    return _runs_in(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))


def _runs_in(data: np.ndarray, sizes: np.ndarray) -> Iterator[_Runs]:
    """The same of texts that lie one after the other in ``data``."""
    ends = np.cumsum(sizes)
    for start, stop in pieces(sizes, _CHUNK):
        high = int(ends[stop - 1])
        for at in range(high - int(sizes[start:stop].sum()), high, _CHUNK):
            part = data[at : min(at + _CHUNK + WINDOW - 1, high)]
            if len(part) >= WINDOW:
                own = np.diff(np.clip(ends[start:stop], at, at + len(part)), prepend=at)
                yield _Runs(part, np.repeat(np.arange(start, stop), own), at)


class _Block:
    """The documents of a block in a fixed order: least doc_id first, those without one last."""

    def __init__(self, table: pa.Table):
        orders, known, sizes, texts = [], [], [], []
        for raw in _buffers(table, "docs"):
            order, has_id, lengths, body = _unpacked(raw, "<i8", "u1", "<u8")
            at = 0
            for n in lengths.tolist():
                texts.append(body[at : at + n])
                at += n
            orders.append(order)
            known.append(has_id > 0)
            sizes.append(lengths.astype(np.int64))
        empty = not texts
        order = np.zeros(0, np.int64) if empty else np.concatenate(orders)
        has_id = np.zeros(0, bool) if empty else np.concatenate(known)
        by_id = np.lexsort((~has_id, order))
        new = np.ones(len(by_id) + 1, bool)
        new[1:-1] = (order[by_id][1:] != order[by_id][:-1]) | (has_id[by_id][1:] != has_id[by_id][:-1])
        cuts = np.flatnonzero(new)
        places = by_id.tolist()
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            places[cuts[k] : cuts[k + 1]] = sorted(places[cuts[k] : cuts[k + 1]], key=lambda i: bytes(texts[i]))
        self.order, self.has_id = order[by_id], has_id[by_id]
        self.sizes = np.zeros(0, np.int64) if empty else np.concatenate(sizes)[places]
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts[i] for i in places), np.uint8)


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch, by block, as compressed frames."""
    for batch in batches:
        ids, blocks = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist()
        for start, stop, texts in text_runs(batch, "text", 1 << 25):
            by_block: dict[int, list[int]] = {}
            for i in range(start, stop):
                by_block.setdefault(blocks[i], []).append(i)
            frames = [
                _packed(
                    np.array([_NO_ID if ids[i] is None else ids[i] for i in own], "<i8"),
                    np.array([ids[i] is not None for i in own], "u1"),
                    np.array([len(texts[i - start]) for i in own], "<u8"),
                    rest=b"".join(texts[i - start] for i in own),
                )
                for own in by_block.values()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(list(by_block), pa.int32()), pa.array(frames, pa.binary())], names=["block", "docs"])


def _dealt(to: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by the part that ``to`` names, in order."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    for part in range(parts):
        if cuts[part] < cuts[part + 1]:
            yield part, order[cuts[part] : cuts[part + 1]]


def _table(names: list[str], rows: Iterable[tuple]) -> pa.Table:
    """Rows of numbers and a frame, in chunks of some MB, of which Spark takes one after the other."""
    schema = pa.schema([(n, pa.int32()) for n in names] + [("frame", pa.binary())])
    chunks, held, size = [], [], 0

    def close() -> None:
        columns = zip(*held) if held else [[]] * len(schema)
        chunks.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        held.clear()

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= _OUT_BYTES:
            close()
            size = 0
    close()
    return pa.Table.from_batches(chunks, schema)


def _ask(parts: int):
    """Which anchors a block holds, how often, and whether in several documents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        let_go_but(None)
        block = _Block(table)
        found = [(r.hash, r.doc.astype(np.int32)) for r in _runs_in(block.data, block.sizes)]
        held, doc = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        del found
        order = np.argsort(held, kind="stable")  # documents come in their order
        held, doc = held[order], doc[order]
        new = np.ones(len(held), bool)
        new[1:] = held[1:] != held[:-1]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(held))
        several = doc[start] != doc[stop - 1] if len(start) else new
        anchors = held[start]
        count = np.minimum(stop[: len(start)] - start, int(_SEVERAL) - 1).astype("<u2") | np.where(several, _SEVERAL, np.uint16(0))
        name = key[0].as_py()

        def rows() -> Iterator[tuple]:
            for part, own in _dealt((anchors % np.uint64(parts)).astype(np.int32), parts):
                six = anchors[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                yield name, part, _packed(np.ascontiguousarray(six).reshape(-1), count[own].astype("<u2"))

        return _table(["block", "part"], rows())

    return run


def _tell(hot_documents: int):
    """Which of a part's anchors lie in two documents or more, for each block that holds them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        let_go_but(None)
        anchors, counts, sizes = [], [], []
        for raw in _buffers(table, "frame"):
            six, count, _ = _unpacked(raw, "u1", "<u2")
            wide = np.zeros((len(count), 8), np.uint8)
            wide[:, :6] = six.reshape(-1, 6)
            anchors.append(wide.view("<u8").reshape(-1))
            counts.append(count)
            sizes.append(len(count))
        anchor, count = np.concatenate(anchors), np.concatenate(counts)
        del anchors, counts
        order = np.argsort(anchor, kind="stable")
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[order][1:] != anchor[order][:-1]
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(anchor)))
        count = count[order]
        shared = (times > 1) | (np.maximum.reduceat(count, start) >= _SEVERAL)
        hot = np.add.reduceat((count & ~_SEVERAL).astype(np.int64), start) > hot_documents
        flag = np.zeros(len(anchor), np.uint8)
        flag[order] = np.repeat(shared + 2 * (shared & hot), times)
        ends = np.cumsum(sizes)

        def rows() -> Iterator[tuple]:
            for name, low, high in zip(table.column("block").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                own = flag[low:high] > 0
                if own.any():
                    yield name, _packed(np.where(flag[low:high] > 2, anchor[low:high] | _HOT, anchor[low:high])[own].astype("<u8"))

        return _table(["block"], rows())

    return run


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _pieces_of(run: _Runs, told: np.ndarray, hot: np.ndarray):
    """Pieces around the told anchors: hash to deal by, start, length, place of the anchor, text; windows of hot ones."""
    at = np.searchsorted(told, run.hash)
    found = np.flatnonzero((at < len(told)) & (told[np.minimum(at, len(told) - 1)] == run.hash)) if len(told) else np.zeros(0, int)
    is_hot = hot[at[found]]
    plain, many = found[~is_hot], found[is_hot]
    start, length = run.first[plain], run.last[plain] - run.first[plain] + WINDOW
    windows = _ranges(run.first[many], run.last[many] - run.first[many] + 1)
    g = run.gram
    own = _mixed(g[windows] * _FACTORS[1] + g[windows + 16] * _FACTORS[2] + g[windows + 32] * _FACTORS[3] + g[windows + 34]) & _HASH
    doc = np.concatenate((run.doc[plain], np.repeat(run.doc[many], run.last[many] - run.first[many] + 1)))
    return (
        np.concatenate((run.hash[plain], own)),
        np.concatenate((start, windows)),
        np.concatenate((length, np.full(len(windows), WINDOW))),
        np.concatenate((run.place[plain] - start, np.full(len(windows), _NO_SIDE))),
        doc,
    )


def _distinct(content: np.ndarray, begin: np.ndarray, length: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct piece, and the number of the piece of each; a hash proposes, the bytes decide."""
    _, first, number = np.unique(content, return_index=True, return_inverse=True)
    same = first[number]
    equal = length[same] == length
    differ = data[_ranges(begin[equal], length[equal])] != data[_ranges(begin[same[equal]], length[equal])]
    if not equal.all() or differ.any():
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(data[a : a + n].tobytes(), len(known)) for a, n in zip(begin.tolist(), length.tolist())], np.int64)
        _, first = np.unique(number, return_index=True)
    return first, number


def _send(parts: int):
    """The pieces of a block, each once with its least document, by part; and for the block itself (key parts + block) where they lie."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        let_go_but(None)
        name = key[0].as_py()
        if not told.num_rows or not docs.num_rows:
            return _table(["block", "part"], [])
        block = _Block(docs)
        told_hash = np.concatenate([_unpacked(raw, "<u8")[0] for raw in _buffers(told, "frame")])
        told_hash = told_hash[np.argsort(told_hash & ~_HOT)]
        hot, told_hash = (told_hash & _HOT) > 0, told_hash & ~_HOT
        found = [[], [], [], [], []]
        for some in _runs_in(block.data, block.sizes):
            deal, start, length, side, _ = _pieces_of(some, told_hash, hot)
            sums = np.zeros(len(some.data) + 1, np.uint64)
            np.cumsum((some.data.astype(np.uint64) + np.uint64(1)) * _power("pieces up", _FACTORS[0], len(some.data)), out=sums[1:])
            down = _power("pieces down", np.uint64(pow(int(_FACTORS[0]), -1, 1 << 64)), len(sums))
            content = _mixed((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))
            for column, values in zip(found, (deal, content, length.astype("u1"), side.astype("u1"), (start + some.at).astype("<u8"))):
                column.append(values)
        del told_hash, hot
        columns = []
        for column in found:
            columns.append(np.concatenate(column))
            column.clear()
        return _table(["block", "part"], _sent(block, name, parts, *columns))

    return run


def _sent(
    block: _Block, name: int, parts: int, deal: np.ndarray, content: np.ndarray, length: np.ndarray, side: np.ndarray, start: np.ndarray
) -> Iterator[tuple]:
    """Rows of block, part and frame: for each part its pieces in shares, and from time to time where the last ones lie."""
    to = (deal % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    kept, held = [], 0
    for part, own in _dealt(to, parts):
        size, begin = length[own].astype(np.int64), start[own].astype(np.int64)
        first, number = _distinct(content[own], begin, size, block.data)
        share = (deal[own[first]] >> _SHARE_BITS).astype(np.int64)
        by_share = np.argsort(share, kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[by_share] = np.arange(len(first))
        first, number = first[by_share], rank[number]
        one = own[first]
        least = np.full(len(one), _NO_ID)
        np.minimum.at(least, number, block.order[np.searchsorted(block.ends, begin, side="right")])
        cuts = np.searchsorted(share[by_share], np.arange(_SHARES + 1)).tolist()
        anchor = (deal[one] // np.uint64(parts) & _FOUR).astype("<u4")
        frames = [
            _packed(
                anchor[low:high], length[one[low:high]], side[one[low:high]], least[low:high].astype("<i8"),
                rest=block.data[_ranges(begin[first[low:high]], size[first[low:high]])].tobytes(),
            ) if low < high else b""
            for low, high in zip(cuts, cuts[1:])
        ]
        yield name, part, np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)
        kept.append((np.full(len(own), part, "<i4"), number.astype("<u4"), start[own], length[own]))
        held += len(own)
        if held >= _LIES_HELD:
            yield name, parts + name, _packed(*(np.concatenate(c) for c in zip(*kept)))
            kept, held = [], 0
    if kept:
        yield name, parts + name, _packed(*(np.concatenate(c) for c in zip(*kept)))


# A piece's share comes from other bits of its hash than its part; of the rest, four bytes tell the anchors of a share apart.
_SHARE_BITS = np.uint64(45)
_FOUR = np.uint64((1 << 32) - 1)
# What a block keeps of each piece that lies in it: part, number in the part, where it starts in the texts of the block, length.
_LIES = ("<i4", "<u4", "<u8", "u1")
_LIES_HELD = 1 << 17


def _shares(raw: pa.Buffer) -> list[memoryview]:
    """The shares of what a block sent to a part, still packed."""
    whole = memoryview(raw)
    at, out = 4 * _SHARES, []
    for n in np.frombuffer(whole, "<u4", _SHARES).tolist():
        out.append(whole[at : at + n])
        at += n
    return out


def _earlier_windows(texts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (piece, first, last) that also lie in a piece with a smaller ``least``."""
    sizes = np.array([len(t) for t in texts])
    data = np.zeros(int((sizes + 1).sum()), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(data)) - starts[piece]
    data[inside < sizes[piece]] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    order = np.array(suffix_array(data), np.int64)
    order = order[inside[order] + WINDOW <= sizes[piece[order]]]
    window = np.lib.stride_tricks.sliding_window_view(data.astype(np.uint8 if data.max() < 256 else np.uint16), WINDOW)
    rows = window[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    owner = np.minimum.reduceat(least[piece[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    late = np.sort(order[owner < least[piece[order]]])
    gap = np.ones(len(late), bool)
    gap[1:] = (late[1:] != late[:-1] + 1) | (piece[late[1:]] != piece[late[:-1]])
    first = late[gap]
    last = late[np.append(np.flatnonzero(gap)[1:] - 1, len(late) - 1)] if len(late) else first
    return piece[first], inside[first], inside[last]


def _longest_shared(sides: list[bytes], deal: np.ndarray) -> np.ndarray:
    """How many first bytes each text has in common with some other text of its anchor: with a neighbour in sorted order."""
    width = WINDOW - GRAM
    sizes = np.array([len(t) for t in sides])
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in sides), np.uint8).reshape(-1, width)
    keyed = np.concatenate((deal.astype(">u8").view(np.uint8).reshape(-1, 8), rows), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{8 + width}").reshape(-1), kind="stable")
    rows, group, size = rows[order], deal[order], sizes[order]
    same = np.minimum.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    same = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)
    best = np.maximum(np.append(-1, same), np.append(same, -1))
    found = np.empty(len(sides), np.int64)
    found[order] = best
    return found


def _shareable(texts: list[bytes], deal: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each piece around its anchor that windows shared with another piece of the anchor can lie in; none if begin = end."""
    left = _longest_shared([t[:at][::-1] for t, at in zip(texts, side.tolist())], deal)
    right = _longest_shared([t[at + GRAM :] for t, at in zip(texts, side.tolist())], deal)
    fits = (left >= 0) & (right >= 0) & (left + GRAM + right >= WINDOW)
    return np.where(fits, side - left, 0), np.where(fits, side + GRAM + right, 0)


# What a part says of a block's pieces: the least document of each; piece, first and last of the windows that an earlier piece has too.
_SAID = ("<i8", "<u4", "u1", "u1")


def _sort(parts: int, sort_bytes: int):
    """For the blocks that the pieces of a part came from, each piece's least document, and its windows that an earlier one has too.

    What a block keeps for itself goes through to it.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        let_go_but(None)
        part = key[0].as_py()
        if part >= parts:
            return _table(["block", "part"], ((part - parts, -1, raw.to_pybytes()) for raw in _buffers(table, "frame")))
        packed = [_shares(raw) for raw in _buffers(table, "frame")]
        said: list[list[tuple]] = [[] for _ in packed]
        for share in range(_SHARES):
            senders = [k for k, frames in enumerate(packed) if len(frames[share])]
            for k, answer in zip(senders, _answers([packed[k][share] for k in senders], sort_bytes)):
                said[k].append(answer)

        def rows() -> Iterator[tuple]:
            for name, answers in zip(table.column("block").to_pylist(), said):
                before = np.cumsum([0] + [len(least) for least, *_ in answers])
                numbered = [(least, piece + n, first, last) for (least, piece, first, last), n in zip(answers, before)]
                yield name, part, _packed(*(np.concatenate(c).astype(kind) for c, kind in zip(zip(*numbered), _SAID)))

        return _table(["block", "part"], rows())

    return run


def _answers(packed: list[memoryview], sort_bytes: int) -> Iterator[tuple]:
    """What a part says of one share: for each block the least document of its pieces, and windows (piece, first, last) of an earlier piece."""
    if not packed:
        return
    numbers: dict[bytes, int] = {}
    deal, side, own, orders, bounds = [], [], [], [], [0]
    for raw in packed:
        hashed, length, place, order, body = _unpacked(raw, "<u4", "u1", "u1", "<i8")
        at = 0
        for h, n, s in zip(hashed.tolist(), length.tolist(), place.tolist()):
            text = bytes(body[at : at + n])
            at += n
            i = numbers.setdefault(text, len(numbers))
            if i == len(deal):
                deal.append(h)
                side.append(s)
            own.append(i)
        orders.append(order)
        bounds.append(len(own))
    texts = list(numbers)
    del numbers
    own, order = np.array(own, np.int64), np.concatenate(orders)
    deal, side = np.array(deal, np.int64), np.array(side)
    least = np.full(len(texts), _NO_ID)
    np.minimum.at(least, own, order)
    # Anchors with different pieces: their suffixes are sorted, some anchors at a time.
    placed = np.flatnonzero(side != _NO_SIDE)
    by_anchor = placed[np.argsort(deal[placed], kind="stable")]
    begin, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if len(by_anchor):
        begin[by_anchor], end[by_anchor] = _shareable([texts[i] for i in by_anchor], deal[by_anchor], side[by_anchor].astype(np.int64))
    chosen = by_anchor[begin[by_anchor] < end[by_anchor]]
    new = np.ones(len(chosen) + 1, bool)
    new[1:-1] = deal[chosen][1:] != deal[chosen][:-1]
    groups = np.flatnonzero(new)
    weight = np.concatenate(([0], np.cumsum((end - begin)[chosen])))
    late = [(np.zeros(0, np.int64),) * 3]
    for low, high in pieces(np.diff(weight[groups]), sort_bytes):
        some = chosen[groups[low] : groups[high]]
        local, first, last = _earlier_windows([texts[i][a:b] for i, a, b in zip(some.tolist(), begin[some].tolist(), end[some].tolist())], least[some])
        late.append((some[local], first + begin[some[local]], last + begin[some[local]]))
    piece, first, last = (np.concatenate(c) for c in zip(*late))
    by_piece = np.argsort(piece, kind="stable")
    piece, first, last = piece[by_piece], first[by_piece], last[by_piece]
    cuts = np.searchsorted(piece, np.arange(len(texts) + 1))
    mine = np.flatnonzero(order == least[own])
    times = cuts[own[mine] + 1] - cuts[own[mine]]
    at = _ranges(cuts[own[mine]], times)
    mine = np.repeat(mine, times)
    first, last, least = first[at].astype("u1"), last[at].astype("u1"), least[own]
    edges = np.searchsorted(mine, bounds).tolist()
    for low, high, a, b in zip(bounds, bounds[1:], edges, edges[1:]):
        yield least[low:high], mine[a:b] - low, first[a:b], last[a:b]


def _hidden(block: _Block, table: pa.Table) -> np.ndarray:
    """Which bytes of a block are covered: by pieces that an earlier document has, and by windows of the others."""
    kept, answers = [], {}
    for part, raw in zip(table.column("part").to_pylist(), _buffers(table, "frame")):
        if part < 0:
            kept.append(raw)
        else:
            answers[part] = raw
    change = np.zeros(len(block.data) + 1, np.int8)  # a window is of one piece, so one run of them starts or ends at a place
    for raw in kept:
        of_part, number, start, length, _ = _unpacked(raw, *_LIES)
        cuts = np.flatnonzero(np.append(True, of_part[1:] != of_part[:-1])).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(of_part)]):
            least, piece, first, last, _ = _unpacked(answers[int(of_part[low])], *_SAID)
            own, begin, size = (a[low:high].astype(np.int64) for a in (number, start, length))
            later = block.order[np.searchsorted(block.ends, begin, side="right")] > least[own]
            np.add.at(change, begin[later], 1)
            np.add.at(change, (begin + size)[later], -1)
            if len(piece):
                held = np.flatnonzero(~later)
                bounds = np.searchsorted(piece, np.arange(len(least) + 1))
                times = bounds[own[held] + 1] - bounds[own[held]]
                which = _ranges(bounds[own[held]], times)
                at = np.repeat(begin[held], times)
                np.add.at(change, at + first[which], 1)
                np.add.at(change, at + last[which] + WINDOW, -1)
    hidden, depth = np.empty(len(block.data), bool), 0
    for at in range(0, len(hidden), _CHUNK):
        depths = np.cumsum(change[at : min(at + _CHUNK, len(hidden))], dtype=np.int64) + depth
        hidden[at : at + _CHUNK] = depths > 0
        depth = depths[-1]
    return hidden


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
     ("kept", pa.binary())]
)
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_kept: bool):
    """What is left of each document of a block."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, covered: pa.Table) -> pa.Table:
        let_go_but(None)
        block = _Block(docs)
        all_hidden = _hidden(block, covered)
        rows = []
        for i, (start, end) in enumerate(zip((block.ends - block.sizes).tolist(), block.ends.tolist())):
            text, hidden = block.data[start:end], all_hidden[start:end]
            removed = int(np.count_nonzero(hidden))
            spans = int(np.count_nonzero(hidden[1:] & ~hidden[:-1])) + int(removed and hidden[0])
            kept = (text[~hidden] if removed else text).tobytes()
            doc_id = int(block.order[i]) if block.has_id[i] else None
            rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT) if rows else _RESULT.empty_table()

    return run


def remove_repeats(
    docs: DataFrame, with_kept: bool = False, hot_documents: int = HOT_DOCUMENTS, sort_bytes: int = SORT_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) the kept bytes of every row of ``docs``.

    Null texts count as empty.  Rows that share a doc_id are no earlier than each other; rows without one are
    later than all others.  Texts of under 50 bytes stay whole.  An empty table gives no rows; other columns are not read.
    Bytes of text are counted first, by a job of its own, so that blocks stay small however few partitions a shuffle has.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(shuffle_parts(docs), -(-total // block_bytes))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    packed = on_arrow(source.withColumn("block", block), _pack_blocks, "block int, docs binary")
    asked = packed.groupBy("block").applyInArrow(_ask(parts), "block int, part int, frame binary")
    told = asked.groupBy("part").applyInArrow(_tell(hot_documents), "block int, frame binary")
    sent = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(parts), "block int, part int, frame binary")
    covered = sent.groupBy("part").applyInArrow(_sort(parts, sort_bytes), "block int, part int, frame binary")
    result = packed.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(_cut(with_kept), _RESULT_SQL)
    return result if with_kept else result.drop("kept")
