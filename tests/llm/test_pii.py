import hashlib
import random
import re

import pytest

from quern.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base finds by the expressions as they are stated."""
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((kind, *m.span()))
    return found


def test_base_against_the_stated_expressions():
    draw = random.Random(11)
    parts = ["@", ".", "a", "b.c", "x-y", "+", "1", "255", "256", " ", "-", "(", ")", "4111 1111 1111 1111", "+49 30 1234567", "é", "\n", "007"]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(30)))
        assert pii.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text, kind, shown, value",
    [
        ("write to john (at) example [dot] com now", "email", "john (at) example [dot] com", "john@example.com"),
        ("mail john dot doe at example dot co dot uk!", "email", "john dot doe at example dot co dot uk", "john.doe@example.co.uk"),
        ("to john @ example.com or", "email", "john @ example.com", "john@example.com"),
        ("see j&#64;x.org", "email", "j&#64;x.org", "j@x.org"),
        ("из jоhn@exаmple.com", "email", "jоhn@exаmple.com", "john@example.com"),
        ("at john@exam​ple.com.", "email", "john@exam​ple.com", "john@example.com"),
        ("juan arroba correo punto es", "email", "juan arroba correo punto es", "juan@correo.es"),
        ("host 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1", "192.168.1.1"),
        ("host one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six", "+493012345 6".replace(" ", "")),
        ("call plus 49 30 1234567", "phone", "plus 49 30 1234567", "+49 30 1234567"),
        ("＋49 30 １２３４５６７", "phone", "＋49 30 １２３４５６７", "+49 30 1234567"),
        ("+1 (555) O12-3456", "phone", "+1 (555) O12-3456", "+1 (555) 012-3456"),
        ("card four triple one " + "one " * 12 + "end", "card", "four triple one " + "one " * 11 + "one", "4" + "1" * 15),
        ("Karte 4111 1111 1111 1111", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ],
)
def test_disguises_are_found_where_they_stand(text, kind, shown, value):
    added = [s for s in pii.find(text) if not s[3]]
    assert [(k, text[a:b], v) for k, a, b, _, v in added] == [(kind, shown, value)]


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "look at example.com and at dots", "one two three four", "he came at ten dot", "version 1.2.3 at home",
        "un an, +1 and two", "point at it. Then go", "a@b", "абв at гд",
    ],
)
def test_clean_texts_have_no_finds(text):
    assert pii.find(text) == []


def test_base_spans_stay_beside_added_ones():
    text = "a@b.com, c (at) d.org, +1 (848) 555-1373 Un an"
    found = pii.find(text)
    assert [s[:3] for s in found if s[3]] == sorted(plain(text), key=lambda s: s[1])
    assert [text[s[1] : s[2]] for s in found if not s[3]] == ["c (at) d.org"]
    assert pii.mask(text, found) == "<email>, <email>, <phone> Un an"


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "a " + "." * 300_000, "one " * 100_000, "а" * 400_000):
        pii.find(text)


def test_rewriting_leads_back():
    step = pii.Rewritten("ab--cd", [(0, 1, ""), (2, 4, "XYZ")])
    assert step.text == "bXYZcd"
    assert [step.back((i, i + 1)) for i in range(6)] == [(1, 2), (2, 4), (2, 4), (2, 4), (4, 5), (5, 6)]


def test_rows_of_the_query(spark):
    schema = "text string, doc_id long, spans string, masked int, more map<string,int>"
    texts = [("x a@b.de", 5), (None, 6), ("", None), ("x a@b.de", 5), ("1.2.3.4 c (at) d.org", 7)]
    df = spark.createDataFrame([(t, d, "s", 1, {"a": 1}) for t, d in texts], schema)
    found = sorted((tuple(r) for r in pii.find_pii(df).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (5, 1, 0, 0, 0, sha("email:2:8"), "email:2:8")
    expected = [one, one, (6, 0, 0, 0, 0, sha(""), ""), (None, 0, 0, 0, 0, sha(""), "")]
    expected.append((7, 0, 1, 0, 0, sha("ip:0:7"), "ip:0:7,email:8:20"))
    assert found == sorted(expected, key=repr)
    assert pii.find_pii(df.where("false")).collect() == []
    assert {r.masked for r in pii.pii_spans(df, masked=True).collect()} == {"x <email>", "", "<ip> <email>"}


def test_the_query_against_the_stated_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = list(BASE)
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = sorted(plain(texts[r.doc_id]), key=lambda s: (s[1], order.index(s[0])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in order]
