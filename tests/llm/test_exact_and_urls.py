import hashlib
import re

import pytest
from compare import compare

from quern.llm import exact_dedup, url_filter
from quern.llm.queries import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    from check import connect

    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), name, folder) == ""


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (2, "a b "), (5, None), (4, ""), (6, " \n"), (7, " "), (None, "a b"), (8, "x" * 300_000)]


@pytest.mark.parametrize("options", [{}, {"hash_bits": 0}, {"trie_bytes": 500, "hash_bits": 3}])
def test_groups_by_brute_force(spark, options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, length int")
    groups = {}
    for d, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    want = []
    for text, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[1] for w in want}
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_trie_spills_whole_subtrees():
    trie = exact_dedup.PatriciaTrie()
    keys = [b"abc", b"abd", b"ab", b"b", b"", b"abc"]
    for i, k in enumerate(keys):
        trie.insert(k, 10 - i)
    spilled = sorted(trie.spill())
    assert spilled == [(b"ab", 8, 1), (b"abc", 5, 2), (b"abd", 9, 1)]
    assert sorted(trie.drain()) == [(b"", 6, 1), (b"b", 7, 1)] and trie.held == 0


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://ORG", "org", "", None, "allow"),
        ("x://a.Example.org/es/q?/de/", "a.example.org", "/es/q", "example.org/es/", "block"),
        ("http://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"), ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("http://a.com:80/de/", "a.com:80", "/de/", None, "allow"), ("a://b://c.com/de/", "b:", "//c.com/de/", None, "allow"),
        ("http://É.com/de/", "É.com", "/de/", "com/de/", "block"), ("", "", "", None, "allow"),
    ],
)
def test_urls(url, host, path, rule, verdict):
    assert url_filter.split_url(url) == (host, path)
    found = url_filter.RuleTrie(url_filter.PRODUCTION_RULES).find(host, path)
    assert (found and found.text) == rule and (found.action if found else "allow") == verdict


def test_url_tables(spark):
    pages = spark.createDataFrame([(None, None, "h"), (1, "http://a.org/x" * 5000, "h"), (1, "http://a.org/x", "h")], "page_id long, url string, host string")
    assert [r.verdict for r in url_filter.filter_urls(pages).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    blocked = url_filter.filter_urls(pages, [url_filter.Rule("allow", "a.org", "/x"), url_filter.Rule("block", "a.org", "/x")])
    assert {r.verdict for r in blocked.collect()} == {"allow", "block"}
