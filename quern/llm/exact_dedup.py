"""Exact dedup: Patricia tries over whole texts, whose terminal nodes own the smallest identifier.

Each map task inserts its normalised texts into one compressed radix trie, so that a text leaves the
task once, however many copies the task holds.  The owners are dealt by (length, content hash) and
inserted again; there a key holds one text but for hash collisions, which the trie tells apart by
their bytes.  The documents themselves travel without their texts and find their owner by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ROW_TYPE, SPACES, on_arrow, private_name, shuffle_parts, text_runs, with_row_key, written

# Bytes of edges that a map task's trie holds before it spills a subtree.
TRIE_BYTES = 16 << 20
_OUT_BYTES = 2 << 20
_ENTRY = pa.schema(
    [("doc_id", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("sha", pa.binary()),
     ("text", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64()),
     ("row", pa.struct([("file", pa.string()), ("row", pa.int64())]))]
)
_ENTRY_SQL = f"doc_id long, length long, hash long, sha binary, text binary, keep_id long, copies long, row {ROW_TYPE}"


class _Node:
    __slots__ = ("edge", "children", "least", "copies")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.least, self.copies = edge, {}, None, 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` and ``b[at:]`` have in common, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings.

    ``insert`` counts a string and keeps its smallest identifier (None is the largest).  ``held`` is
    the size of all edges; ``spill`` takes out the strings of the largest subtree below the root.
    """

    def __init__(self) -> None:
        self.root, self.held = _Node(b""), 0
        self._sizes: dict[int, int] = {}

    def insert(self, key: bytes, identifier: int | None, copies: int = 1) -> None:
        node, at, before = self.root, 0, self.held
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.held += len(key) - at + 200
            elif not key.startswith(child.edge, at):
                same = _shared(child.edge, key, at)
                fork = _Node(child.edge[:same])
                child.edge = child.edge[same:]
                fork.children[child.edge[0]] = child
                node.children[key[at]] = child = fork
                self.held += 200
            node, at = child, at + len(child.edge)
        if identifier is not None and (node.least is None or identifier < node.least):
            node.least = identifier
        node.copies += copies
        if key:
            self._sizes[key[0]] = self._sizes.get(key[0], 0) + self.held - before

    @staticmethod
    def _terminals(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.edge
            if node.copies:
                yield whole, node.least, node.copies
            stack.extend((child, whole) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        first = max(self._sizes, key=self._sizes.get)
        self.held -= self._sizes.pop(first)
        return self._terminals(self.root.children.pop(first), b"")

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        root, self.root, self.held, self._sizes = self.root, _Node(b""), 0, {}
        return self._terminals(root, b"")


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; nothing is trimmed."""
    if not text:
        return text
    words = b" ".join(text.split())
    if not words:
        return b" "
    return b" " * (text[0] in SPACES) + words + b" " * (text[-1] in SPACES)


def key_of(text: bytes, bits: int) -> tuple[int, int, bytes]:
    """Length, the first ``bits`` bits of the content hash, and the whole hash."""
    sha = hashlib.sha256(text).digest()
    return len(text), int.from_bytes(sha[:8], "big", signed=True) >> (64 - bits), sha


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)


def _entries(id_column: str, text_column: str, trie_bytes: int, bits: int) -> Callable:
    """Map side: a row without text for each document, and a row with text for each string of the trie."""

    def owners(found: Iterator) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, least, copies in found:
            rows.append((None, *key_of(text, bits), text, least, copies, None))
            size += len(text)
            if size > _OUT_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            ids, keys = batch.column(id_column), batch.column("row")
            for start, stop, texts in text_runs(batch, text_column, _OUT_BYTES):
                rows = []
                for doc_id, text, key in zip(ids.slice(start, stop - start).to_pylist(), texts, keys.slice(start, stop - start).to_pylist()):
                    text = normalise(text)
                    trie.insert(text, doc_id)
                    rows.append((doc_id, *key_of(text, bits), None, None, None, key))
                yield _batch(rows)
                while trie.held > trie_bytes:
                    yield from owners(trie.spill())
        yield from owners(trie.drain())

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: owners sorted by key; one trie for each (length, hash), let go when the key ends."""
    schema = pa.schema([("length", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])

    def out(trie: PatriciaTrie) -> pa.RecordBatch:
        rows = [(len(t), hashlib.sha256(t).digest(), least, n) for t, least, n in trie.drain()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    trie, key, ready = PatriciaTrie(), None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("length", "hash", "text", "keep_id", "copies")]
        for length, value, text, least, copies in zip(*columns):
            if key is not None and key != (length, value):
                ready.append(out(trie))
                if len(ready) >= 2000:
                    yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                    ready = []
            key = (length, value)
            trie.insert(text, least, copies)
    if key is not None:
        ready.append(out(trie))
        yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]


def _owned(source: DataFrame, trie_bytes: int = TRIE_BYTES, hash_bits: int = 64) -> DataFrame:
    """(doc_id, row, length, sha, keep_id, copies) of rows (doc_id, text, row); ``row`` is carried along."""
    entries = written(on_arrow(source, _entries("doc_id", "text", trie_bytes, hash_bits), _ENTRY_SQL), "exact-dedup")
    dealt = (
        entries.where("copies is not null")
        .select("length", "hash", "text", "keep_id", "copies")
        .repartition(shuffle_parts(source), "length", "hash")
        .sortWithinPartitions("length", "hash")
    )
    owners = on_arrow(dealt, _merge, "length long, sha binary, keep_id long, copies long")
    return entries.where("copies is null").select("doc_id", "row", "length", "sha").join(owners, ["length", "sha"])


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    trie_bytes: int = TRIE_BYTES, hash_bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Equal texts are one group, kept by its smallest identifier.  Null and empty texts are equal to each
    other, and differ from texts of white space only, which are one space.  A row that repeats the
    owner's identifier is kept as well.  A null identifier is larger than any other: such rows
    are dropped unless all rows of their text lack one, and then all of them are kept.  An empty table gives no rows; other columns are not read.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.lit(None).cast(ROW_TYPE).alias("row")
    )
    return _owned(source, trie_bytes, hash_bits).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, exactly one for each text, with all their columns.

    It is the row of the owner's identifier; of several rows with it the first by file and place.  Rows are told apart by
    their own keys, so rows that share an identifier, or lack one, are judged by their text alone.
    """
    name = private_name(docs)
    keyed = with_row_key(docs, name)
    source = keyed.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(name).alias("row")
    )
    own = _owned(source).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = own.groupBy("length", "sha").agg(F.min("row").alias(name)).select(name)
    return keyed.join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents),
g as (select n, min(doc_id) as keep_id, count(*) as group_size from t group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from t join g using (n)
"""
