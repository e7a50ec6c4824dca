"""Token ids in wavelet matrices: one compressed file per shard, which can be read and asked in place.

A plane holds one bit of every id, from the highest; below it the ids follow with those of a 0 first.  A plane is
compressed in blocks, and its directory in the file has the ones before each block and where the block's frame lies: that gives rank,
and a search in it select, so a token, the number of a token's occurrences and where they are come from a block or two per plane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, private_name, shuffle_parts, texts_of, with_row_key, written
from quern.llm.tokens import KEPT, byte_encoder

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
# Ids of a shard, but for a longer document.
SHARD_TOKENS = 4_000_000

_MAGIC = b"WAVE2"
_HEAD = struct.Struct("<5sBQQQ")  # magic, planes, ids, documents, bytes of the documents' frame
_PLANE = struct.Struct("<QQQ")  # zeros, blocks, bytes of all frames
# Bytes of a plane that are compressed together, and blocks that an open file holds unpacked.
BLOCK_BYTES = 4096
HELD_BLOCKS = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: head, documents, then each plane with its directory and the frames of its blocks."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    documents = pack(doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + np.packbits(has_id).tobytes())
    out = [_HEAD.pack(_MAGIC, planes, len(ids), len(doc_ids), len(documents)), documents]
    order = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    below = np.empty_like(order)
    for plane in range(planes - 1, -1, -1):
        one = order.dtype.type(1 << plane)
        frames, ones, zeros, waiting = [], [], 0, []
        # Ids are moved a block at a time, which stays in the processor's caches: zeros to the front, ones when all zeros are known.
        for at in range(0, len(order), 8 * BLOCK_BYTES):
            some = order[at : at + 8 * BLOCK_BYTES]
            bit = (some & one) != 0
            frames.append(pack(np.packbits(bit)))
            ones.append(np.count_nonzero(bit))
            if not plane:
                zeros += len(bit) - ones[-1]
                continue
            unset, found = np.flatnonzero(~bit), np.flatnonzero(bit)
            some.take(unset, out=below[zeros : zeros + len(unset)], mode="clip")
            waiting.append(some.take(found, mode="clip"))
            zeros += len(unset)
        before = np.concatenate(([0], np.cumsum(ones)))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
        out.append(_PLANE.pack(zeros, len(frames), int(ends[-1])))
        out += [before.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), *frames]
        if waiting:
            np.concatenate(waiting, out=below[zeros:])
            order, below = below, order
    return b"".join(out)


class WaveletFile:
    """A shard's file: ``ids`` reads all, ``access``, ``rank``, ``count`` and ``select`` ask in place.

    Opening reads the head and directories; documents and blocks are unpacked when they are asked for.
    """

    def __init__(self, raw: bytes):
        magic, planes, self.n, self._docs, size = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet file")
        self._raw, self._unpack = raw, zstandard.ZstdDecompressor().decompress
        self._documents_at = at = _HEAD.size, _HEAD.size + size
        at = at[1]
        self.zeros: list[int] = []
        self._before: list[np.ndarray] = []
        self._frames: list[np.ndarray] = []
        for _ in range(planes):
            zeros, blocks, size = _PLANE.unpack_from(raw, at)
            at += _PLANE.size
            self.zeros.append(zeros)
            self._before.append(np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64))
            at += 8 * (blocks + 1)
            self._frames.append(np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64) + at + 8 * (blocks + 1))
            at += 8 * (blocks + 1) + size
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _documents(self) -> bytes:
        return self._unpack(self._raw[slice(*self._documents_at)])

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._documents(), "<i8", self._docs)

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._documents(), "<u8", self._docs, self._docs * 8).astype(np.int64)

    @property
    def has_id(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._documents(), np.uint8, -1, self._docs * 16), count=self._docs).astype(bool)

    @property
    def planes(self) -> int:
        return len(self.zeros)

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = plane, block
        if key not in self._held:
            if len(self._held) >= HELD_BLOCKS:
                self._held.pop(next(iter(self._held)))
            a, b = self._frames[plane][block : block + 2].tolist()
            self._held[key] = np.frombuffer(self._unpack(self._raw[a:b]), np.uint8)
        return self._held[key]

    def ids(self) -> np.ndarray:
        """All ids: from the lowest plane up, each undoes its move of zeros to the front."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        order, above = np.empty(self.n, kind), np.empty(self.n, kind)
        for depth in range(self.planes):
            plane = self.planes - 1 - depth
            ends, one = self._frames[plane].tolist(), kind(1 << depth)
            from_zero, from_one = 0, self.zeros[plane]
            for at, a, b in zip(range(0, self.n, 8 * BLOCK_BYTES), ends, ends[1:]):
                some = above[at : at + 8 * BLOCK_BYTES]
                bit = np.unpackbits(np.frombuffer(self._unpack(self._raw[a:b]), np.uint8), count=len(some)).view(bool)
                if not depth:
                    some[:] = bit
                    continue
                unset, found = np.flatnonzero(~bit), np.flatnonzero(bit)
                some[unset] = order[from_zero : from_zero + len(unset)]
                some[found] = order[from_one : from_one + len(found)] | one
                from_zero, from_one = from_zero + len(unset), from_one + len(found)
            order, above = above, order
        return order

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        block, byte = at // 8 // BLOCK_BYTES, at // 8 % BLOCK_BYTES
        n = int(self._before[plane][block])
        if at % (8 * BLOCK_BYTES) == 0:
            return n
        bits = self._block(plane, block)
        n += int(_ONES[bits[:byte]].sum())
        return n + (bin(int(bits[byte]) >> (8 - at % 8)).count("1") if at % 8 else 0)

    def _bit(self, plane: int, at: int) -> int:
        return int(self._block(plane, at // 8 // BLOCK_BYTES)[at // 8 % BLOCK_BYTES]) >> (7 - at % 8) & 1

    def _select(self, plane: int, one: int, wanted: int) -> int:
        """The place of the bit ``one`` with ``wanted`` such bits before it: by the directory, then within the block."""
        before = self._before[plane]
        if not one:
            before = np.minimum(np.arange(len(before)) * 8 * BLOCK_BYTES, self.n) - before
        block = int(np.searchsorted(before, wanted, "right")) - 1
        bits = np.unpackbits(self._block(plane, block))
        return block * 8 * BLOCK_BYTES + int(np.flatnonzero(bits == one)[wanted - int(before[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            bit = self._bit(plane, at)
            ones = self._ones(plane, at)
            value, at = value * 2 + bit, zeros + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, start), self._ones(plane, stop)
            one = token >> (self.planes - 1 - plane) & 1
            start, stop = (zeros + a, zeros + b) if one else (start - a, stop - b)
        return start, stop

    def rank(self, token: int, at: int) -> int:
        """Occurrences of a token before a place."""
        return self.count(token, 0, at)

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        first, last = self._range(token, start, self.n if stop is None else stop)
        return last - first

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence, from 0; -1 if there are not so many."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= k < last - first:
            return -1
        at = first + k
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at


def _build(path: str, shard_tokens: int):
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = byte_encoder(path), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = seq = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            names = np.array([d or 0 for d in docs], np.int64)
            known = np.array([d is not None for d in docs], bool)
            file = encode_file(ids, names, known, np.array([len(p) // 4 for p in parts], np.int64))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, seq, len(ids), file), schema)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch(texts_of(batch.column("text")))):
                docs.append(doc_id)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= shard_tokens:
                    yield shard()
                    docs, parts, held, seq = [], [], 0, seq + 1
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files, in ascending doc_id order, and give their table: part, seq, n_tokens, file.

    The order of (part, seq) is the order of doc_id, nulls first.  The table lies in the shared folder.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    name = private_name(docs)
    source = with_row_key(docs, name).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash"), F.col(name).alias("row"), F.col("text").cast("string").alias("text")
    )
    # Rows of one doc_id, or without one, are told apart by their texts and their keys, so that they need not meet in one task.
    order = ["doc_id", "hash", "row"]
    ordered = source.repartitionByRange(shuffle_parts(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(
        on_arrow(ordered, _build(path, shard_tokens), "part long, seq long, n_tokens long, file binary", KEPT), "wavelet"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, raw in zip(*[batch.column(c).to_pylist() for c in ("part", "seq", "file")]):
            file = WaveletFile(raw)
            ids, lengths = file.ids().astype("<u4"), file.lengths
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part)), pa.array(np.full(n, seq)),
                    pa.array(file.doc_ids, pa.int64(), mask=~file.has_id), pa.array(starts),
                    pa.array(lengths), pa.array(crc, pa.int64()),
                ],
                names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of ``write_shards``.

    The running total over shards is a window of one task with a small row for each four million ids.
    """
    schema = "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    found = on_arrow(shards.select("part", "seq", "file"), _read, schema)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return found.join(firsts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` and read them back.

    Null and empty texts are their end id alone.  Documents without doc_id come first; rows that share a doc_id
    are documents of their own, in the order of a hash of their texts.  An empty table gives no rows.
    """
    return read_documents(write_shards(docs, **options))
