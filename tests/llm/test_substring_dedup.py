import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quern.llm import substring_dedup
from quern.llm.common import table
from quern.llm.grouping_sa import suffix_array


def plain(rows, n=50):
    """Per row (doc_id, bytes, removed, spans, digest), with the least document of every window in a dict."""
    last = float("inf")
    first = {}
    raw = [(last if d is None else d, d, (t or "").encode()) for d, t in rows]
    for at, _, text in raw:
        for p in range(len(text) - n + 1):
            w = text[p : p + n]
            if first.get(w, last) >= at:
                first[w] = at
    out = []
    for at, doc_id, text in raw:
        hidden = bytearray(len(text))
        for p in range(len(text) - n + 1):
            if first[text[p : p + n]] < at:
                hidden[p : p + n] = b"\1" * n
        kept = bytes(c for c, h in zip(text, hidden) if not h)
        spans = sum(1 for i, h in enumerate(hidden) if h and (i == 0 or not hidden[i - 1]))
        out.append((doc_id, len(text), sum(hidden), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(docs, **options):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot_documents": 3, "sort_bytes": 500}])
def test_whole_table_against_brute_force(spark, options):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    expected = plain([tuple(r) for r in docs.collect()])
    assert ours(docs, **options) == expected and sum(r[2] for r in expected) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(30, 200))) for _ in range(6)]
    pool += ["ab" * 60, "z" * 150]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            text = rng.choice(pool)
            a, b = sorted((rng.randrange(len(text)), rng.randrange(len(text) + 1)))
            parts.append(rng.choice((text, text[a:b], rng.choice("xyz"))))
        rows.append((rng.choice((i, i, i // 2, None)), "".join(parts) if i % 9 else None))
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, block string")
    expected = plain(rows)
    for options in ({}, {"hot_documents": 4, "sort_bytes": 300}):
        assert ours(docs, **options) == expected


def test_long_text_and_empty_table(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long[500_000:500_300]), (2, long), (3, long[524_200:524_400] + "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == {1: (300, 0, 0), 2: (1_300_000, 300, 1), 3: (201, 200, 1)}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for turn in range(1500):
        k = rng.choice((1, 2, 3, 5, 255))
        text = [rng.randrange(k) for _ in range(rng.randrange(40))]
        if turn % 3 == 0 and text:
            text = (text[: rng.randrange(1, len(text) + 1)] * 20)[: len(text)]
        assert suffix_array(np.array(text, np.int64)) == sorted(range(len(text)), key=lambda i: text[i:])


def test_pieces_that_share_a_hash_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    begin, length = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    for content in (np.array([7, 7, 7, 7], np.uint64), np.array([5, 9, 5, 1], np.uint64)):
        first, number = substring_dedup._distinct(content, begin, length, data)
        texts = [bytes(data[b : b + n]) for b, n in zip(begin, length)]
        assert [texts[first[k]] for k in number] == texts and len(first) == 3


def test_a_passage_of_many_documents_is_one_piece_a_block(spark):
    """What the parts get does not grow with the documents that hold a passage; only the blocks know all of them."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    sizes = []
    for many in (200, 2000):
        rows = [(i, f"{i} {passage}") for i in range(many)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = substring_dedup.remove_repeats(docs, hot_documents=50).collect()
        assert sum(r.n_removed == 0 for r in found) == 1
        assert all(r.n_removed >= 400 for r in found if r.n_removed)
        texts = [t.encode() for _, t in rows]
        run = next(substring_dedup._runs(texts))
        told = np.unique(run.hash)
        deal, start, length, side, doc = substring_dedup._pieces_of(run, told, np.zeros(len(told), bool))
        content = np.array([hash(bytes(run.data[a : a + n])) & (2**63 - 1) for a, n in zip(start, length)], np.uint64)
        first, _ = substring_dedup._distinct(content, start, length, run.data)
        ends = [n for a, n in zip(start[first], length[first]) if passage.encode().find(bytes(run.data[a : a + n])) >= 0]
        sizes.append(sum(ends))
    assert sizes[0] == sizes[1]


def test_a_block_has_its_bytes_however_few_partitions_a_shuffle_has(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcd é\n") for _ in range(120)) for _ in range(5)]
    rows = [(i // 2 if i % 7 else None, f"{i}{rng.choice(pool)}{rng.choice(pool)[:70]}") for i in range(80)]
    rows += [(3, None), (None, ""), (90, "x" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)
    pack = substring_dedup._pack_blocks

    def counting(batches):
        for batch in pack(batches):
            seen.add(batch.num_rows)
            yield batch

    assert ours(docs, block_bytes=400) == plain(rows)
    substring_dedup._pack_blocks = counting
    try:
        ours(docs.coalesce(1), block_bytes=1000)
    finally:
        substring_dedup._pack_blocks = pack
    assert seen.value > 8  # one batch, so one row for each block; the shuffle has 8 partitions


def peak_mb(run):
    tracemalloc.start()
    found = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, peak / 1e6


def test_memory_of_a_block_and_a_part_whose_text_is_all_shared():
    """3 MB of text, all of whose anchors other blocks hold too, a sixth of them hot."""
    letters = np.frombuffer(b"abcdefghijklmnop qrstuvwxyz", np.uint8)
    drawn = letters[np.random.default_rng(7).integers(0, len(letters), 3_000_000)].tobytes()
    texts = [drawn[a : a + 3000].decode() for a in range(0, len(drawn), 3000)]
    told = np.unique(np.concatenate([run.hash for run in substring_dedup._runs([t.encode() for t in texts])]))
    told = np.where(np.arange(len(told)) % 6, told, told | substring_dedup._HOT).astype("<u8")
    said = pa.table({"frame": pa.array([substring_dedup._packed(told)], pa.binary())})

    def packed(block):
        batch = pa.record_batch({"text": texts, "doc_id": list(range(len(texts))), "block": pa.array(block, pa.int32())})
        return pa.Table.from_batches(list(substring_dedup._pack_blocks(iter([batch]))))

    whole = packed([0] * len(texts)).select(["docs"])
    key = (pa.scalar(0, pa.int32()),)
    sent, of_block = peak_mb(lambda: substring_dedup._send(16)(key, whole, said))
    sent = sent.filter(pc.less(sent.column("part"), 16))
    assert sent.num_rows == 16
    tables = []
    for block, docs in enumerate(packed([i // 50 for i in range(len(texts))]).column("docs")):
        one = substring_dedup._send(1)((pa.scalar(block, pa.int32()),), pa.table({"docs": [docs.as_py()]}), said)
        tables.append(one.filter(pc.equal(one.column("part"), 0)))
    part = pa.concat_tables(tables)
    assert part.num_rows == 20
    answers, of_part = peak_mb(lambda: substring_dedup._sort(1, substring_dedup.SORT_BYTES)(key, part))
    assert answers.num_rows == 20
    assert of_block < 110 and of_part < 90, (of_block, of_part)
