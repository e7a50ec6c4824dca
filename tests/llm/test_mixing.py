import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def fair(sizes, weights, repeats=3):
    """Targets by handing out what capped sources leave, round by round."""
    target, capped = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        if not free:
            return target
        for s in free:
            target[s] = left * weights[s] / sum(weights[f] for f in free)
        over = [s for s in free if target[s] > repeats * sizes[s] + 1e-9]
        for s in over:
            target[s] = repeats * sizes[s]
        if not over:
            return target
        capped.update(over)


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "w " * n if n else None, "k") for i, s, n in rows], "doc_id long, source string, text string, target string")


def test_targets_and_words(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("b", 900), ("a", 10), ("a", 5), ("é", 300), ("é", 77), (None, 40), (None, 0), ("z", 1)] * 3)]
    rows += [(None, "b", 7), (3, "é", 300), (3, "é", 300)]
    found = mixing.taken(frame(spark, rows), block_words=64, shards=8).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fair(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    by_target = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert {k for k in by_target} == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (_, target), group in by_target.items():
        assert abs(sum(r.taken for r in group) - target) <= 1
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    again = mixing.taken(frame(spark, rows[::-1]).repartition(3), block_words=64, shards=8).collect()
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_pieces_fill_blocks_of_shards(spark):
    rows = [(i, "ab"[i % 2], 1 + i * 37 % 90) for i in range(200)]
    pieces = mixing.mix(frame(spark, rows), block_words=50, shards=8).where("words > 0").collect()
    assert all(p.shard is not None and 0 <= p.at and p.at + p.words <= p.size for p in pieces)
    blocks = mixing.shard_blocks(mixing.source_targets(frame(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size"))), 8, 50, "mix").collect()
    assert len({(b.source_no, b.block) for b in blocks}) == len(blocks)
    share = [sum(b.shard == s for b in blocks) for s in range(8)]
    assert max(share) - min(share) <= 1


def test_shards_draw_permuted_blocks_by_the_quotas_of_the_tree(spark):
    rows = [(i, "abc"[i % 3], 1 + i * 37 % 90) for i in range(400)]
    sized = frame(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size"))
    targets = mixing.source_targets(sized)
    quotas = {(q.shard, q.source_no): q.blocks for q in mixing.shard_quotas(targets, 64, 20, "mix").collect()}
    blocks = mixing.shard_blocks(targets, 64, 20, "mix").collect()
    drawn = {}
    for b in blocks:
        drawn[b.shard, b.source_no] = drawn.get((b.shard, b.source_no), 0) + 1
    assert drawn == {k: n for k, n in quotas.items() if n} and len({k for k, _ in quotas}) == 64
    per_source = {}
    for b in blocks:
        per_source.setdefault(b.source_no, []).append((b.block, b.shard))
    want = {t.source_no: -(-int(t.target) // 20) for t in targets.collect()}
    for no, found in per_source.items():
        assert sorted(b for b, _ in found) == list(range(want[no]))
        shards = [s for _, s in sorted(found)]
        assert shards != sorted(shards)
    # The whole tree splits alike, however many levels a step takes.
    before, mixing._LEVELS_AT_ONCE = mixing._LEVELS_AT_ONCE, 2
    try:
        again = {(q.shard, q.source_no): q.blocks for q in mixing.shard_quotas(targets, 64, 20, "mix").collect()}
    finally:
        mixing._LEVELS_AT_ONCE = before
    assert again == quotas


def test_without_the_tree_nothing_is_taken(spark, monkeypatch):
    nothing = lambda targets, *_: targets.select("source_no", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("shard")).where("false")
    monkeypatch.setattr(mixing, "shard_blocks", nothing)
    assert {r.taken for r in mixing.taken(frame(spark, [(1, "a", 10), (2, "b", 100)])).collect()} == {0}


def test_mixed_documents_with_repeated_ids_and_clashing_columns(spark):
    rows = [(7, "one two three", "a"), (7, "four five", "a"), (None, "six", "b"), (None, "six", "b"), (8, None, None), (9, "seven", None)]
    schema = "doc_id long, text string, source string, _row int, _taken string, size int, more map<string,int>"
    docs = spark.createDataFrame([(*r, 1, "x", 2, {"a": 1}) for r in rows], schema)
    words = {}
    found = mixing.mixed_documents(docs, block_words=2)
    assert found.columns == docs.columns
    for r in found.collect():
        words[r.doc_id, r.text.split()[0]] = words.get((r.doc_id, r.text.split()[0]), 0) + len(r.text.split())
        assert r.more == {"a": 1} and r._row == 1
    want = sorted(r.taken for r in mixing.taken(docs.select("doc_id", "text", "source"), block_words=2).collect() if r.taken)
    assert sum(words.values()) == sum(want)


@pytest.mark.parametrize("population,marked,drawn", [(20, 7, 9), (10, 10, 4), (6, 0, 3), (5, 3, 5), (1000, 400, 500)])
def test_hypergeometric_law(spark, population, marked, drawn):
    long = lambda v: F.lit(v).cast("long")
    got = spark.range(4000).select(mixing._hypergeometric(long(population), long(marked), long(drawn), (F.col("id") + 0.5) / 4000.0).alias("x"))
    values = [r.x for r in got.collect()]
    mean = drawn * marked / population
    spread = mean * (1 - marked / population) * (population - drawn) / max(1, population - 1)
    assert min(values) >= max(0, drawn - population + marked) and max(values) <= min(marked, drawn)
    assert abs(sum(values) / 4000 - mean) < 0.02 * max(1, mean)
    assert abs(sum((v - mean) ** 2 for v in values) / 4000 - spread) < 0.05 * max(1, spread)


def test_mixed_documents(spark):
    rows = [(1, "a", 10), (2, "b", 100), (3, "b", 50), (4, "c", 0)]
    out = mixing.mixed_documents(frame(spark, rows), block_words=8)
    assert out.columns == ["doc_id", "source", "text", "target"]
    by = {r.doc_id: r.taken for r in mixing.taken(frame(spark, rows), block_words=8).collect()}
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: n for d, n in by.items() if n}


def test_empty_table(spark):
    assert mixing.taken(frame(spark, []).limit(0)).count() == 0
    nothing = mixing.taken(frame(spark, [(1, "a", 0), (2, None, 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
