import re

import pytest

from quern.llm import near_join
from quern.llm.common import table


def plain(rows, n=5, a=4, b=5):
    """doc_id: (copy_of, class_id, n_links), by comparing all pairs of distinct texts."""
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(tuple(re.findall(r"[^\x20\x09-\x0D]+", text or "")), []).append(doc_id)
    reps = {w: min(ids) for w, ids in texts.items()}
    sets = {reps[w]: {w[i : i + n] for i in range(max(1, len(w) - n + 1))} if w else set() for w in texts}
    links, root = dict.fromkeys(sets, 0), {r: r for r in sets}
    by_gram = {}
    for r, grams in sets.items():
        for g in grams:
            by_gram.setdefault(g, []).append(r)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r, grams in sets.items():
        for s in {s for g in grams for s in by_gram[g] if s > r}:
            both = len(grams & sets[s])
            if b * both >= a * (len(grams) + len(sets[s]) - both):
                links[r] += 1
                links[s] += 1
                x, y = top(r), top(s)
                root[max(x, y)] = min(x, y)
    return {d: (reps[w], top(reps[w]), links[reps[w]]) for w, ids in texts.items() for d in ids}


@pytest.mark.parametrize("options", [{}, {"block_texts": 3, "block_grams": 300}])
def test_whole_table_against_brute_force(spark, options):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    found = {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in near_join.jaccard_join(docs, **options).collect()}
    expected = plain([tuple(r) for r in docs.collect()])
    assert found == expected and sum(n for _, _, n in expected.values()) > 10


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one\ttwo "), (6, "one two three"), (7, long), (7, long), (8, long + " end")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, label string")
    found = {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in near_join.jaccard_join(docs).collect()}
    assert found == plain(rows) and found[7] == (7, 7, 1) and found[2] == (1, 1, 0)
    assert near_join.jaccard_join(docs).count() == 9
    assert near_join.jaccard_join(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in near_join.jaccard_join(nameless).collect()) == [(0, 0), (0, 3), (3, 3)]


def test_hot_group_in_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, i * 7 % 120) for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in near_join.jaccard_join(docs, block_texts=11).collect()}
    assert found == plain(rows)


def test_prefix_is_shortened_to_the_target():
    length = near_join.prefix_length(0.8, 40, 12, 0.99999)
    assert 1 - (1 - 0.8**length) ** 40 >= 0.99999 > 1 - (1 - 0.8 ** (length + 1)) ** 40
