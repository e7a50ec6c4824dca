import hashlib
import zlib

import pytest
from compare import compare
from pyspark.sql import functions as F

from quern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    d, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (d, source, lang, n, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(level):
    """All levels from the leaves to the root."""
    levels = [level]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        levels.append(level)
    return levels


def way(levels, at):
    """Per level, from the leaf up, the digests before and after the node in its run."""
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    levels = [climb([leaf(r) for r in tree]) for tree in trees]
    top = climb([found[-1][0] for found in levels])
    out = []
    for t, tree in enumerate(trees):
        for i, row in enumerate(tree):
            path = way(levels[t], i) + way(top, t)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = leaf(row, changed)
            for before, after in path:
                now = sha("".join(before) + now + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            out.append((row[0], leaf(row), levels[t][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in merkle.verify_documents(df).collect()), key=repr)


ODD = [
    (1, "Some TEXT", "en", "s", 9), (1, "Some TEXT", "en", "s", 9), (1, "other", "en", None, 5), (None, "A", "en", "s", 1),
    (None, None, None, None, None), (2, "", "", "s", 0), (3, "Ä" * 3000 + "B", "de", "s", 3001), (-7, "Z", "de", "=x", 1), (12, "ab", "é", "s", 2),
]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[:2], [(i, f"Text {i}", "en", "s", i) for i in range(9)],
                                  [(i % 150, f"Text {i}", f"l{i % 11}" if i % 3 else "big", "s", i) for i in range(700)]])
def test_against_plain_trees(spark, rows):
    df = spark.createDataFrame([(*r, 1, {"a": 2}) for r in rows], SCHEMA + ", digest int, root map<string,int>")
    assert found(df) == plain(rows)


def test_an_empty_table_has_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_requests_for_some_leaves(spark):
    """A request brings its proof alone, from trees of other heights too, and its other columns."""
    rows = [(i, f"Text {i}", "en" if i < 600 else "de" if i < 605 else f"l{i}", "s", i) for i in range(625)]
    made = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)))
    asked = spark.createDataFrame([("=en", 599, "last"), ("=de", 4, "short"), ("=l610", 0, "alone"), ("=en", 599, "again")], "tree string, rank long, why string")
    every = {(r.tree, r.rank): r.path for r in made.proofs().collect()}
    some = made.proofs(asked).collect()
    assert sorted(r.why for r in some) == ["again", "alone", "last", "short"] and len(every) == 625
    assert all(every[r.tree, r.rank] == r.path for r in some)
    folded = made.proofs(asked).select(merkle.fold(F.col("digest"), F.col("path")).alias("f"), merkle.fold(F.lit("x"), F.col("path")).alias("g")).collect()
    assert {r.f for r in folded} == {made.root} and made.root not in {r.g for r in folded}


def test_against_sql(spark):
    from check import connect

    assert compare(spark, connect("/root/testdata/sf0.001"), "op12_merkle_manifest", "/root/testdata/sf0.001") == ""
