"""N-gram Jaccard join: MinHash banding proposes, whole sets of word n-grams decide.

Every text gets one number per band, of 6 hashes with the defaults: the most at which a pair right at the
threshold meets in some of the 40 bands with the target recall.  Bands give edges to their smallest member, and so groups
of texts that may be alike.  In each group, cut into blocks if it is large, all pairs are verified on their
full sets inside the tasks, which report links per text and who belongs together, but no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ROW_TYPE, on_arrow, private_name, shuffle_parts, text_runs, texts_of, with_row_key, written
from quern.llm.components import components
from quern.llm.quality import Texts
from quern.operators.skew import checked_broadcast

WORDS = 5
# Similarity as a fraction of whole numbers.
THRESHOLD = (4, 5)
TREES = 40
LABEL_HASHES = 12
TARGET_RECALL = 0.99999
# What a task verifies at once: texts and n-grams of a block, two blocks at a time.
BLOCK_TEXTS = 128
BLOCK_GRAMS = 500_000
_PIECE_BYTES = 1 << 18


def prefix_length(similarity: float, trees: int, longest: int, recall: float) -> int:
    """Shorten the prefix until pairs of ``similarity`` meet in one of the trees with ``recall``."""
    length = longest
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def shingles(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``n`` words and the texts they are from, in order of the texts.

    A text of fewer words is one run; a text without words has none.
    """
    runs, first = texts.grams(n)
    doc = texts.doc[first]
    words = np.bincount(texts.doc, minlength=texts.n)
    starts = np.concatenate(([0], np.cumsum(words)))
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        own = [int.from_bytes(hashlib.blake2b(texts.word_hash[starts[i] : starts[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short]
        runs, doc = np.concatenate((runs, np.array(own, np.uint64))), np.concatenate((doc, short))
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], doc[new]


def _labels(texts: Texts, n: int, trees: int, length: int) -> list[np.ndarray | None]:
    """Per text the prefix of each tree's label, as one number a tree."""
    runs, doc = shingles(texts, n)
    present, starts = np.unique(doc, return_index=True)
    out: list[np.ndarray | None] = [None] * texts.n
    if not len(present):
        return out
    draw = np.random.default_rng(20)
    high = (runs >> np.uint64(32)).astype(np.uint32)
    labels = np.empty((trees, len(present)), np.uint64)
    for tree in range(trees):
        label = np.full(len(present), tree, np.uint64)
        for _ in range(length):
            flip, factor = draw.integers(0, 1 << 32, 2, np.uint32)
            mixed = (high ^ flip) * (factor | np.uint32(1))
            label = (label ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
            label ^= label >> np.uint64(29)
        labels[tree] = label
    for i, column in zip(present.tolist(), labels.T.view(np.int64)):
        out[i] = column
    return out


def text_key(text: bytes) -> bytes:
    """The words of a text as 16 bytes."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def name_of(doc_id: int | None, key: bytes) -> bytes:
    """A text's name; names are ordered by doc_id, those without last, then by text key."""
    return (b"\1" + bytes(8) if doc_id is None else b"\0" + (doc_id + (1 << 63)).to_bytes(8, "big")) + key


def _sign(n: int, trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, stop, some in text_runs(batch, "text", _PIECE_BYTES):
                keys = [text_key(t) for t in some]
                first = {k: i for i, k in reversed(list(enumerate(keys)))}
                distinct = list(first.values())
                labels = dict(zip(distinct, _labels(Texts([some[i] for i in distinct]), n, trees, length)))
                found = [labels[first[k]] for k in keys]
                columns = [
                    pa.array(doc_ids[start:stop], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([name_of(d, k) for d, k in zip(doc_ids[start:stop], keys)], pa.binary()),
                    batch.column("row").slice(start, stop - start),
                    pa.array([len(t) for t in some], pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "name", "row", "size", "labels"])

    return run


def verify(texts: list[bytes], split: int | None, n: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text and the first text of its group, over all pairs, or those across two blocks.

    ``split`` is the number of texts of the first block if there are two.
    """
    runs, doc = shingles(Texts(texts), n)
    many = len(texts)
    sizes = np.bincount(doc, minlength=many)
    _, gram, often = np.unique(runs, return_inverse=True, return_counts=True)
    shared = often[gram] > 1
    gram, doc = gram[shared], doc[shared]
    posting = doc[np.argsort(gram, kind="stable")]
    held = np.bincount(gram, minlength=len(often))
    ends = np.cumsum(held)
    begins = ends - held
    cuts = np.searchsorted(doc, np.arange(many + 1))
    links, group = np.zeros(many, np.int64), np.arange(many)
    a, b = threshold
    for i in range(many if split is None else split):
        own = gram[cuts[i] : cuts[i + 1]]
        lengths = held[own]
        at = np.arange(lengths.sum()) + np.repeat(begins[own] - (np.cumsum(lengths) - lengths), lengths)
        both = np.bincount(posting[at], minlength=many)
        like = (both > 0) & ((a + b) * both >= a * (sizes + sizes[i]))
        like[: i + 1 if split is None else split] = False
        found = np.flatnonzero(like)
        if len(found):
            links[i] += len(found)
            links[found] += 1
            met = np.unique(np.append(group[found], group[i]))
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
    return links, group


def _verify(n: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, texts, sides = None, [], [], []

        def done() -> pa.RecordBatch:
            order = sorted(range(len(docs)), key=lambda i: (sides[i], docs[i], texts[i]))
            order = [i for at, i in enumerate(order) if not at or docs[order[at - 1]] != docs[i]]  # dealt by several tasks
            split = sum(not sides[i] for i in order) if key[1] != key[2] else None
            links, root = verify([texts[i] for i in order], split, n, threshold)
            names, least = [docs[i] for i in order], {}
            for r, name in zip(root.tolist(), names):
                least[r] = min(name, least.get(r, name))
            met = [least[r] for r in root.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(links), pa.array(met, pa.binary())], names=["node", "links", "with_node"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "first", "second", "node", "side")]
            for *here, node, side, text in zip(*columns, texts_of(batch.column("text"))):
                if key is not None and here != key:
                    yield done()
                    docs, texts, sides = [], [], []
                key = here
                docs.append(node)
                texts.append(text)
                sides.append(side)
        if docs:
            yield done()

    return run


def jaccard_join(
    docs: DataFrame, n: int = WORDS, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES,
    recall: float = TARGET_RECALL, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_of, class_id, n_links.

    Texts of the same words are copies, ``copy_of`` their smallest doc_id.  ``n_links`` counts the other texts whose
    sets of ``n``-word runs have the Jaccard similarity ``threshold`` or more, copies once; ``class_id`` is the
    smallest doc_id among all that links connect.  Texts of fewer words are one run; null, empty and white
    texts are copies of each other without links.  Rows without doc_id are linked like others and get the class of
    their text, null if no row of it has a doc_id.  Rows that share a doc_id are rows of their own.  An empty table gives no rows.
    """
    name = private_name(docs)
    found = _joined(_keyed_source(with_row_key(docs, name), name), n, threshold, trees, recall, block_texts, block_grams)
    return found.select("doc_id", "copy_of", "class_id", "n_links")


def _keyed_source(keyed: DataFrame, name: str) -> DataFrame:
    return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(name).alias("row"))


def _joined(
    docs: DataFrame, n: int = WORDS, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES,
    recall: float = TARGET_RECALL, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """``jaccard_join`` of rows (doc_id, text, row) with row, name of the row's text and class_name, the least name of the class."""
    length = prefix_length(threshold[0] / threshold[1], trees, LABEL_HASHES, recall)
    schema = f"doc_id long, text_key binary, name binary, row {ROW_TYPE}, size long, labels array<long>"
    signed = written(on_arrow(docs, _sign(n, trees, length), schema), "signatures")
    owners = signed.groupBy("text_key").agg(F.min(F.struct("name", "row", "size", "doc_id")).alias("_least")).select(
        "text_key", F.col("_least.name").alias("node"), "_least.row", "_least.size", F.col("_least.doc_id").alias("copy_of")
    )
    texts = signed.where("labels is not null").groupBy("text_key").agg(F.min("name").alias("node"), F.first("labels").alias("labels"))
    members = texts.select("node", F.posexplode("labels").alias("tree", "label"))
    nodes = members.groupBy("tree", "label").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last")
    edges = members.join(nodes, ["tree", "label"]).select("u", F.col("node").alias("v")).where("u <> v").distinct()
    groups = written(components(written(edges, "forest-edges")), "groups")
    blocks = _blocks(owners, groups, block_texts, block_grams)
    verified = written(_verified(docs, blocks, n, threshold), "links")
    joined = components(verified.where("node <> with_node").select(F.col("node").alias("u"), F.col("with_node").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = (
        owners.select("text_key", "node", "copy_of").join(links, "node", "left").join(joined, "node", "left")
        .select("text_key", "copy_of", F.coalesce("component", "node").alias("class_name"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    # The number in a name is doc_id + 2^63, which flips the sign bit.
    number = F.conv(F.hex(F.substring("class_name", 2, 8)), 16, -10).cast("long")
    class_id = F.when(F.hex(F.substring("class_name", 1, 1)) == "00", number.bitwiseXOR(F.lit(-(1 << 63))))
    return signed.select("doc_id", "text_key", "name", "row").join(classes, "text_key", "left").select(
        "doc_id", "copy_of", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "row", "name", "class_name",
    )


def _blocks(owners: DataFrame, groups: DataFrame, block_texts: int, block_grams: int) -> DataFrame:
    """(row, node, component, block, blocks): the block of each text of a group, by a hash of its name."""
    sizes = owners.select("node", "row", "size").join(groups, "node")
    totals = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), (F.sum("size") / 5).alias("grams"))
    blocks = F.greatest(F.ceil(F.col("texts") / block_texts), F.ceil(F.col("grams") / block_grams)).cast("int")
    # Few components are larger than a block, and only those need their number of blocks joined back.
    large = totals.select("component", blocks.alias("many")).where("many > 1")
    counted = sizes.drop("size").join(checked_broadcast(large), "component", "left").withColumn("blocks", F.coalesce("many", F.lit(1))).drop("many")
    return counted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _verified(source: DataFrame, blocks: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(node, links, with_node): of each text in each pair of blocks of its group."""
    dealt = source.join(blocks, "row")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(F.col("block"), other).alias("first"),
            F.greatest(F.col("block"), other).alias("second"),
            (F.col("block") > other).alias("side"),
        ),
    )
    spread = dealt.select("node", "text", "component", F.explode(pairs).alias("_pair")).select(
        "component", "_pair.first", "_pair.second", "node", "_pair.side", "text"
    )
    keys = ["component", "first", "second"]
    ready = spread.repartition(shuffle_parts(source), *keys).sortWithinPartitions(*keys)
    return on_arrow(ready, _verify(n, threshold), "node binary, links long, with_node binary")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    It is the row of the class's smallest doc_id, rows without doc_id last, then of the smallest text key; of rows
    that share both, the first by file and place.
    """
    name = private_name(docs)
    keyed = with_row_key(docs, name)
    found = _joined(_keyed_source(keyed, name), **options)
    kept = found.where("name = class_name").groupBy("class_name").agg(F.min("row").alias(name)).select(name)
    return keyed.join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
