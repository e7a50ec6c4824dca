import re
from collections import Counter

from quern.llm import quality
from quern.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts, word by word."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    rows = quality.quality(docs, table(spark, folder, "labels")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c d e " * 4, "x\n\nx\n x\nx", "é è ü\x1cz", "w " * 30_000, "same", "same", "l1\nl2\nl1"]
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    rows = sorted(quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect(), key=lambda r: r.doc_id or 0)
    for r, t in zip(rows, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_held_out_accuracy(spark):
    """Trained on a part of the labelled rows, right on the rest; labels of one class keep or drop all."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    part = labels.where("doc_id % 2 = 0")
    scored = quality.quality(docs, part).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum((r.probability >= 0.5) == bool(r.quality) for r in scored)
    assert right >= 0.95 * len(scored)
    good = [r for r in scored if r.quality and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    again = {r.doc_id: r.probability for r in quality.quality(docs.repartition(5), part).collect()}
    assert all(abs(again[r.doc_id] - r.probability) < 1e-6 for r in scored)
