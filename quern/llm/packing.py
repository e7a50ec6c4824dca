"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are dealt and ordered by a hash; a task fills one group after the other with documents up to a
number of tokens and packs each by itself.  Whole windows of a document are sequences of their own;
what is left of documents goes, longest first, into the first sequence with room, found by
descending a tree of the largest free room below each node.  What first-fit leaves open is then filled by
cutting the pieces of the emptiest sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ROW_TYPE, on_arrow, private_name, shuffle_parts, with_row_key
from quern.llm.tokens import KEPT, word_encoder

SEQUENCE = 4096
END_ID = 2
# Tokens of a group: what a task holds at once, but for a longer document.
GROUP_TOKENS = 2_000_000
TOKENIZER = "word_bpe_49k.json"

Piece = tuple[int, int, int]  # document's number in the group, start, length


class RoomTree:
    """Free room of bins in order; ``first`` finds the first bin with room for ``n``."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first(self, n: int) -> int:
        node, most = 1, self.most
        if most[1] < n:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if most[node] < n:
                node += 1
        return node - self.leaves

    def take(self, at: int, n: int) -> None:
        node, most = at + self.leaves, self.most
        most[node] -= n
        while node > 1:
            node //= 2
            larger = max(most[2 * node], most[2 * node + 1])
            if most[node] == larger:
                break
            most[node] = larger


def first_fit_decreasing(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Bins of at most ``size`` tokens."""
    tree, bins = RoomTree(len(pieces), size), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0])):
        at = tree.first(piece[2])
        tree.take(at, piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return bins


def fill_up(bins: list[list[Piece]], size: int) -> list[list[Piece]]:
    """Fill the open room of the fullest bins with pieces of the emptiest, cutting where needed.

    At most one bin is left partly filled; it is cut into sequences at powers of two, which need no padding.
    """
    fills = [sum(p[2] for p in b) for b in bins]
    done = [b for b, n in zip(bins, fills) if n == size]
    rest = [bins[i] for i in sorted((i for i, n in enumerate(fills) if n < size), key=lambda i: -fills[i])]
    room = [size - sum(p[2] for p in b) for b in rest]
    into, last = 0, len(rest) - 1
    while into < last:
        doc, start, length = rest[last].pop()
        moved = min(length, room[into])
        rest[into].append((doc, start, moved))
        room[into] -= moved
        if moved < length:
            rest[last].append((doc, start + moved, length - moved))
        if not rest[last]:
            last -= 1
        if not room[into]:
            into += 1
    done += [b for b in rest[:last]]
    left = rest[last] if rest else []
    while left:
        total = sum(p[2] for p in left)
        want, sequence = 1 << (total.bit_length() - 1), []
        while want:
            doc, start, length = left.pop(0)
            moved = min(length, want)
            sequence.append((doc, start, moved))
            if moved < length:
                left.insert(0, (doc, start + moved, length - moved))
            want -= moved
        done.append(sequence)
    return done


def pack_group(lengths: list[int], size: int = SEQUENCE) -> list[list[Piece]]:
    """Sequences of the documents of a group; pieces of one document that meet stay in order."""
    whole = [[(i, at, size)] for i, n in enumerate(lengths) for at in range(0, n - size + 1, size)]
    rest = [(i, n - n % size, n % size) for i, n in enumerate(lengths) if n % size]
    return whole + fill_up(first_fit_decreasing(rest, size), size)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([END_ID], "<u4").tobytes()
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            ids = [i + end for i in encoder.batch([t or "" for t in batch.column("text").to_pylist()])]
            deal = [zlib.crc32(i) for i in ids]
            held = ids if wide else [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(deal, pa.int64()), batch.column("row"), pa.array(held, pa.binary())],
                names=["doc_id", "deal", "row", "ids"],
            )

    return run


def _pack(path: str, size: int, group_tokens: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u4" if word_encoder(path).tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        sequence = TaskContext.get().partitionId() << 40
        group: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in pack_group([len(ids) for _, ids in group], size):
                offset = 0
                for i, start, length in pieces:
                    doc_id, ids = group[i]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), sequence, offset))
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                group.append((doc_id, np.frombuffer(ids, kind)))
                held += len(group[-1][1])
                if held >= group_tokens:
                    yield packed()
                    group, held = [], 0
        if group:
            yield packed()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone.  Rows that share a doc_id, or lack one, are documents of their
    own.  An empty table gives no rows; other columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    name = private_name(docs)
    source = with_row_key(docs, name).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("row"), F.col("text").cast("string").alias("text")
    )
    encoded = on_arrow(source, _encode(path), f"doc_id long, deal long, row {ROW_TYPE}, ids binary", KEPT)
    # Equal rows, such as empty texts without doc_id, are dealt apart by their keys.
    order = F.xxhash64("doc_id", "deal", "row")
    dealt = encoded.repartition(shuffle_parts(docs), order).sortWithinPartitions(order, "doc_id", "deal", "row").select("doc_id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return on_arrow(dealt, _pack(path, size, group_tokens), schema, KEPT)
