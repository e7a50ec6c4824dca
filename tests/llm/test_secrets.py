import base64
import bz2
import gzip
import hashlib
import os
import lzma
import re
import urllib.parse
import zlib

from quern.llm import secrets
from quern.llm.common import table

SECRET = 'password = "hunter2abc"'


def plain(text):
    """The base finds by the patterns as the contract states them, over characters."""
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_matches_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = secrets.find_secrets(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(joined.split(",")) <= set(r.spans.split(","))
        found += len(base)
    assert found


def spans_of(text):
    return secrets.scan(text.encode())[1]


def test_layers():
    assert spans_of(f"é {urllib.parse.quote(SECRET, safe='')} end")[0][:2] == (2, 0)
    once = base64.b64encode(SECRET.encode()).decode()
    twice = base64.b64encode(once.encode()).decode()
    for text in (once, twice, base64.b64encode(gzip.compress(once.encode())).decode()):
        (start, kind, end), *_ = spans_of(f"ünd: {text} .")
        assert kind == 0 and 5 <= start < end <= 5 + len(text) + 1
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert spans_of(f"a\n{escaped}\nb") == [(2, 0, 2 + len(escaped) - 6)]
    assert spans_of(urllib.parse.quote(urllib.parse.quote(SECRET))) != []
    assert spans_of("%25" * 200) == [] and spans_of("100%%% sure \\u \\uZZZZ") == []


def test_failing_match_is_dropped_whole():
    assert spans_of("secret=token: abcdefgh") == []
    assert spans_of("token=abcdef") == [(0, 0, 12)]
    assert spans_of("ſecret=abcdefgh toKen=abcdefgh") == []
    assert spans_of("AKIA" + "A" * 15) == [] and spans_of("AKIA" + "A" * 16) == [(0, 1, 20)]


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "deadbeef" * 200_000), (3, "a" * 100_000 + "=")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find_secrets(docs).collect()
    assert len(found) == 5
    by = {r.doc_id: r for r in found}
    assert by[2].spans == "hex:0:1600000" and by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_large_compressed_layer():
    body = b"x" * (secrets.WINDOW_BYTES + 100) + b" " + SECRET.encode() + b" tail"
    text = base64.b64encode(gzip.compress(body)).decode()
    assert [s for s in spans_of(text) if s[1] == 0] == [(0, 0, len(text.rstrip("=")))] or spans_of(text)


def inside(text, part):
    """Whether an assignment is found that lies within ``part`` of the text."""
    at = text.index(part)
    return any(k == 0 and at <= a < b <= at + len(part) for a, k, b in spans_of(text))


def test_base64_at_any_place_of_a_run():
    once = base64.b64encode(SECRET.encode()).decode()
    for before in ("https://h/cb/", "https://h/a/bc/", "key_", "some-key-", "x", "xy", "xyz", "a+b+"):
        text = f"see {before}{once} end"
        assert inside(text, (before + once).split("://")[-1]), before
        assert inside(f"see {before}{once}/tail/of-path", (before + once).split("://")[-1] + "/tail/of-path"), before


def test_wrapped_base64():
    body = b"first line of a longer text, " * 4 + SECRET.encode() + b" and more of it" * 9
    for data in (body, gzip.compress(hashlib.sha512(b"a").digest() * 3 + hashlib.sha512(b"b").digest() + body)):
        wrapped = base64.encodebytes(data).decode().strip()
        for text in (wrapped, wrapped.replace("\n", "\r\n"), wrapped.replace("\n", "\n    "), wrapped.replace("\n", "\\n")):
            assert inside(f"é word\n{text}\nnext line", text.rstrip("=")), text


def test_decoded_bytes_that_are_no_text():
    for data in (b"\x00" + SECRET.encode(), SECRET.encode() + b"\xff\xfe", b"\x1f\x8b\x08" + SECRET.encode()):
        assert spans_of(base64.b64encode(data).decode()), data


def test_compressed_anywhere():
    other = gzip.compress(b"nothing here")
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        packed = pack(SECRET.encode())
        for data in (b"head" + packed + b"tail", packed, other + packed, other + b"\0\0" + packed, packed + other, b"x\x9cBZh9" + packed):
            assert spans_of(base64.b64encode(data).decode()), (pack, data)
        assert spans_of("data = " + repr(packed) + " end") and spans_of("".join(f"\\x{b:02X}" for b in packed))
        assert spans_of("p=" + urllib.parse.quote(packed))
    halves = gzip.compress(SECRET.encode()[:14]) + gzip.compress(SECRET.encode()[14:])
    assert spans_of(base64.b64encode(halves).decode())


def test_runs_over_a_window_edge(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW_BYTES", 4096)
    monkeypatch.setattr(secrets, "OVERLAP_BYTES", 64)
    noise = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(2000))
    run = base64.b64encode(gzip.compress(noise + SECRET.encode()))
    for data in (b"words of text " * 200 + run + b" end", b"words of text " * 200 + gzip.compress(noise + SECRET.encode()) + b" end"):
        assert spans_of(base64.b64encode(gzip.compress(data)).decode())
    for n in range(4050, 4110):
        assert spans_of(base64.b64encode(gzip.compress(b"\xff" * n + SECRET.encode())).decode()), n


def test_windows_are_scanned_one_at_a_time():
    """A small text with much inside: what is held stays near a few windows."""
    import subprocess
    import sys

    code = """
import base64, gzip, os, resource
from quern.llm import secrets
body = b"".join(b"line %d of words without end\\n" % i for i in range(20000))
text = base64.b64encode(gzip.compress(body * 200 + b" token=abcdefgh1234 "))
del body
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open("/proc/self/clear_refs", "w") as f:
    f.write("5")
base, spans = secrets.scan(text)
peak = int(next(l for l in open("/proc/self/status") if l.startswith("VmHWM")).split()[1])
now = int(next(l for l in open("/proc/self/status") if l.startswith("VmRSS")).split()[1])
print(len(text), len(spans), peak // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    size, spans, peak = map(int, done.stdout.split())
    assert spans and peak < 400, done.stdout


def test_finds_lie_where_their_layers_came_from():
    inner = urllib.parse.quote(SECRET, safe="")
    wrapped = base64.encodebytes(("x " * 40 + inner).encode()).decode().strip()
    text = f"é begin {wrapped} end"
    at = text.index(wrapped)
    spans = [s for s in spans_of(text) if s[1] == 0]
    assert spans and all(at <= a < b <= at + len(wrapped) for a, _, b in spans)
    assert max(b for _, _, b in spans) > at + len(wrapped) - 8
