import math
import re
from collections import Counter

import pytest
from compare import compare

from quern.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    many, words = len(found), sum(sum(c.values()) for _, c in found)
    out = []
    for item, text in {i for i in items if i[1] is not None}:
        scored = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * many // words
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * sum(t in o for _, o in found) + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


DOCS = [(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(i % 23))) for i in range(300)]
ODD = [(1, "Red RED blue"), (1, "red red blue"), (None, "blue"), (2, None), (3, ""), (4, "--- \n"), (5, "Été été \x00red"), (6, "blue " * 40_000)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, {"a": 1}) for d in docs], "doc_id long, text string, score int, terms map<string,int>"),
        spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int"),
    )


@pytest.mark.parametrize("coordinates", [1, 16, 512])
@pytest.mark.parametrize("docs, items", [
    (DOCS, [(i, " ".join(f"w{(i * 3 + j) % 45}" for j in range(6))) for i in range(12)]),
    (ODD, [(1, "red blue blue"), (2, None), (3, ""), (None, "ÉTÉ"), (1, "red blue blue"), (1, "blue"), (9, "nothing here")]),
])
def test_against_all_scores(spark, docs, items, coordinates):
    left, right = frames(spark, docs, items)
    assert found(search.ranked_search(left, right, coordinates=coordinates)) == plain(docs, items)


def test_blocks_of_queries_give_the_same(spark):
    items = [(i, f"w{i} w{i + 1} w5") for i in range(30)]
    left, right = frames(spark, DOCS, items)
    assert found(search.ranked_search(left, right, top=3, block_items=4)) == plain(DOCS, items, 3)


def test_empty_tables(spark):
    left, right = frames(spark, DOCS, [(1, "w1")])
    assert found(search.ranked_search(left.where("false"), right)) == found(search.ranked_search(left, right.where("false"))) == []


def test_bounds_are_above_scores_and_prune():
    """Sketches bound every score, and with many coordinates few documents reach the threshold."""
    import numpy as np

    draw = np.random.default_rng(3)
    starts = np.arange(0, 2001 * 5, 5)
    terms, impacts = draw.integers(0, 3000, 10_000), draw.integers(1, 10**9, 10_000)
    for coordinates in (8, 512):
        sketches = search.Sketches(starts, terms, impacts, coordinates)
        own, lookups, often = np.arange(20), np.zeros((coordinates, 1)), np.zeros(3000, np.int64)
        np.add.at(lookups[:, 0], search.coordinate(own, coordinates), 1)
        often[own] = 1
        bounds, scores = sketches.bounds(lookups)[:, 0], sketches.scores(np.arange(2000), often)
        assert (bounds >= scores).all()
    assert (bounds >= np.sort(scores)[-20]).sum() < 400


def test_against_sql(spark):
    from check import connect

    assert compare(spark, connect("/root/testdata/sf0.001"), "op13_lexical_search", "/root/testdata/sf0.001") == ""
