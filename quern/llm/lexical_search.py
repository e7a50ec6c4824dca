"""Ranked lexical search: a stated set of queries against all documents, pruned by max-sketches of the documents' impacts.

A first pass keeps, of each document, its length and how often it has each term of the queries, and counts what the weights need.
A document's impacts are then folded into a sketch: each term hashes to a coordinate, and a coordinate holds the largest impact
folded into it.  A query reads its terms' coordinates, which bounds its score from above; all queries of a block read the sketches of
a run of documents at once.  Going down by bound, scores are worked out exactly until no bound reaches the twentieth score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import on_arrow, pieces, shuffle_parts, texts_of, written

TOP = 20
# Queries that go over the documents together: what is sent to the tasks, and the width of their bounds.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 1_000
# Coordinates of a sketch, documents sketched at once, and documents scored between two looks at the threshold.
COORDINATES = 512
RUN_DOCUMENTS = 2_048
_SCORED_AT_ONCE = 64
_PIECE_BYTES = 4 << 20

# Bytes of terms as they count, all others as spaces; bytes of other alphabets belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other alphabets, with A-Z in lower case."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


_FORWARD = "doc_id long, n long, terms binary, counts binary, term int, df long, documents long, words long"


def _forward(vocabulary: dict[bytes, int]):
    """Per document its length and the counts of query terms; per task and term the documents that hold it, and the task's totals."""
    names = [part.split()[0] for part in _FORWARD.split(", ")]
    many = max(1, len(vocabulary))

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        types = {"terms": pa.binary(), "counts": pa.binary(), "term": pa.int32()}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = np.zeros(many, np.int64), 0, 0
        for batch in batches:
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id")
            for start, stop in pieces(np.array([len(t) for t in texts]), _PIECE_BYTES):
                sizes, known = [], []
                for text in texts[start:stop]:
                    words = terms_of(text)
                    sizes.append(len(words))
                    known.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)))
                n = np.array(sizes, np.int64)
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
                all_ids = np.concatenate(known)
                doc = np.repeat(np.arange(len(n)), n)
                kept = all_ids >= 0
                pair, often = np.unique(doc[kept] * many + all_ids[kept], return_counts=True)
                doc, term = pair // many, (pair % many).astype("<i4")
                held += np.bincount(term, minlength=many)
                present, first = np.unique(doc, return_index=True)
                if not len(present):
                    continue
                cuts = (4 * np.append(first, len(doc))).tolist()
                raw_terms, raw_counts = term.tobytes(), often.astype("<i4").tobytes()
                yield rows(
                    doc_id=ids.slice(start, stop - start).take(pa.array(present)),
                    n=pa.array(n[present]),
                    terms=pa.array([raw_terms[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    counts=pa.array([raw_counts[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                )
        found = np.flatnonzero(held)
        if len(found):
            yield rows(term=pa.array(found.astype(np.int32)), df=pa.array(held[found]))
        if documents:
            yield rows(documents=pa.array([documents]), words=pa.array([total]))

    return run


class Sketches:
    """The impacts of a run of documents and their max-sketches.

    ``starts`` cuts ``terms`` and ``impacts`` by document.  A term's coordinate is a hash of its number.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, coordinates: int):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        many = len(starts) - 1
        doc = np.repeat(np.arange(many), np.diff(starts))
        self.table = np.zeros((many, coordinates))
        np.maximum.at(self.table.reshape(-1), doc * coordinates + coordinate(terms, coordinates), impacts.astype(np.float64))

    def bounds(self, lookups: np.ndarray) -> np.ndarray:
        """Upper bounds (documents x queries); ``lookups`` has how often a query reads each coordinate, a column a query."""
        return self.table @ lookups

    def scores(self, docs: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for the query that has term ``t`` ``often[t]`` times."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        at = np.arange(lengths.sum()) + np.repeat(self.starts[docs] - (np.cumsum(lengths) - lengths), lengths)
        part = self.impacts[at] * often[self.terms[at]]
        return np.add.reduceat(part, np.cumsum(lengths) - lengths)


def coordinate(terms: np.ndarray, coordinates: int) -> np.ndarray:
    mixed = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64)


class Best:
    """The best ``top`` documents of a query so far: falling score, then doc_id, those without last."""

    def __init__(self, top: int):
        self.top, self.found = top, []

    @property
    def threshold(self) -> int:
        """A score below this one cannot get in."""
        return -self.found[-1][0] if len(self.found) >= self.top else 1

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        self.found += [(-s, d is None, d or 0) for s, d in zip(scores, ids)]
        self.found = sorted(self.found)[: self.top]


def _search(items: list[tuple[int, int | None, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, words: int, top: int, coordinates: int):
    """The best documents of a task for each query (number, item_id, terms, how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = np.zeros((coordinates, len(items)))
        for q, (_, _, terms, often) in enumerate(items):
            np.add.at(lookups[:, q], coordinate(terms, coordinates), often)
        best = [Best(top) for _ in items]
        asked = np.zeros(max(1, len(weights)), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, RUN_DOCUMENTS):
                some = batch.slice(begin, RUN_DOCUMENTS)
                ids = some.column("doc_id").to_pylist()
                n = some.column("n").to_numpy(zero_copy_only=False)
                raw = some.column("terms").to_pylist()
                starts = np.concatenate(([0], np.cumsum([len(t) // 4 for t in raw]))).astype(np.int64)
                terms = np.frombuffer(b"".join(raw), "<i4")
                tf = np.frombuffer(b"".join(some.column("counts").to_pylist()), "<i4").astype(np.int64)
                m = np.repeat(100 - 25 + (25 * n * documents) // words, np.diff(starts))
                sketches = Sketches(starts, terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)), coordinates)
                bounds = sketches.bounds(lookups)
                # Sums of whole numbers that doubles hold; the margin is for those beyond.
                bounds *= 1 + 1e-9
                for q, (_, _, own, often) in enumerate(items):
                    column, mine = bounds[:, q], best[q]
                    order = np.flatnonzero(column >= mine.threshold)
                    if not len(order):
                        continue
                    order = order[np.argsort(-column[order], kind="stable")]
                    asked[own] = often
                    for at in range(0, len(order), _SCORED_AT_ONCE):
                        docs = order[at : at + _SCORED_AT_ONCE]
                        docs = docs[column[docs] >= mine.threshold]
                        if not len(docs):
                            break
                        scores = sketches.scores(docs, asked)
                        good = scores >= mine.threshold
                        if good.any():
                            mine.add(scores[good].tolist(), [ids[d] for d in docs[good].tolist()])
                    asked[own] = 0
        rows = [(number, item, None if none else d, -s) for (number, item, *_), b in zip(items, best) for s, none, d in b.found]
        if rows:
            names, types = ("item", "item_id", "doc_id", "score"), (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _block(source: DataFrame, found: list[tuple[int | None, str]], top: int, coordinates: int) -> DataFrame | None:
    """(item, item_id, doc_id, score): the best of each task for the queries of a block."""
    vocabulary: dict[bytes, int] = {}
    counted = []
    for item_id, text in found:
        often = Counter(terms_of(text.encode()))
        counted.append((item_id, [(vocabulary.setdefault(t, len(vocabulary)), c) for t, c in often.items()]))
    forward = written(on_arrow(source, _forward(vocabulary), _FORWARD), "forward")
    documents, words = forward.agg(F.sum("documents"), F.sum("words")).first()
    if not documents or not vocabulary:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    # One row per term of the block's queries, which the block's size bounds.
    for term, holding in forward.where("term is not null").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = weight(documents, holding)
    items = [
        (i, item_id, np.array([t for t, _ in terms], np.int64), np.array([c for _, c in terms], np.int64))
        for i, (item_id, terms) in enumerate(counted)
    ]
    postings = forward.where("terms is not null").select("doc_id", "n", "terms", "counts")
    return on_arrow(postings, _search(items, weights, documents, words, top, coordinates), "item int, item_id long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, coordinates: int = COORDINATES,
    block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with a score above 0 of each row (item_id, text) of ``items``.

    Equal scores go by doc_id, a null one last.  Each row of ``docs`` is a document of its own, repeated rows too.  Rows of ``items``
    that are equal are one item; of one item_id with several texts each text is ranked by itself.  Null and empty texts have no terms:
    such documents count nowhere, such items have no rows, and empty tables give none.  Other columns are not read.

    Queries that exceed a block go over the documents in several, dealt by hash; the blocks' size bounds what reaches the driver.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    count, size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // block_items), -(-(size or 0) // block_bytes))
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = sorted((tuple(r) for r in mine.collect()), key=repr)
        part = _block(source, found, top, coordinates) if found else None
        if part is not None:
            parts.append(part.withColumn("block", F.lit(b)))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Each task has sent its best; those are ranked in parts first, as they are more for more tasks.
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_parts(docs))))
    ranked = _ranked(_ranked(salted, ["block", "item", "salt"], top), ["block", "item"], top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
s as (select count(*) as docs, sum(len(w))::bigint as words from d where len(w) > 0),
p as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by 1, 2),
i as (select distinct item_id, text from benchmark where text is not null),
q as (select item_id, text, t, count(*) as qf from (
        select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from i) group by 1, 2, 3),
v as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s where t in (select t from q) group by t, docs),
m as (select r, doc_id, 75 + (25 * len(w) * docs) // words as m from d, s where len(w) > 0),
x as (select item_id, text, r, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score, any_value(doc_id) as doc_id
      from q join v using (t) join p using (t) join m using (r) group by 1, 2, 3)
select item_id, rank, doc_id, score from (
    select *, cast(row_number() over (partition by item_id, text order by score desc, doc_id) as int) as rank from x where score > 0)
where rank <= 20
"""
