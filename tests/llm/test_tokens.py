import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing, wavelet
from quern.llm.common import table
from quern.llm.tokens import byte_encoder, word_encoder

ODD = [
    None, "", " ", "\n", "\n\na  b\n c \n", "it's  naïve x y", "a<|endoftext|>b <|startoftext|> <|end", "tab\tx", "\x1cz y",
    "İI ß Σας ΟΔΟΣ é ́x", "a\r\nb", "日本 語 1234 56", "'s 't x's", "trailing ", " leading", "z" * 5000, "a\nb\n", "\na b",
]


def plain(name, text):
    path = public_tokenizers.path(name)
    plain.cache = getattr(plain, "cache", {})
    if name not in plain.cache:
        plain.cache[name] = Tokenizer.from_file(path)
    return plain.cache[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", byte_encoder), ("word_bpe_49k.json", word_encoder)])
def test_encoder_is_exact(spark, name, make):
    encoder = make(public_tokenizers.path(name))
    texts = ODD + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    random.seed(5)
    texts += ["".join(random.choice(" \n\tab'sé.1<|") for _ in range(random.randrange(40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder.ids(text or ""), "<u4").tolist() == plain(name, text), repr(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_query_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], docs.schema))
    rows = sorted(wavelet.encode_documents(docs, shard_tokens=5000).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(rows, sorted(docs.collect(), key=lambda d: d.doc_id)):
        ids = plain("byte_bpe_50k.json", d.text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_wavelet_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (3, "x"), (3, "x")], "doc_id long, text string")
    rows = wavelet.encode_documents(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 3, 3] and rows[0].n_tokens == 1
    assert wavelet.encode_documents(docs.limit(0)).count() == 0


def test_wavelet_file_asks_in_place():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5000, 50257), (3000, 7)):
        ids = rng.integers(0, top, n)
        file = wavelet.WaveletFile(wavelet.encode_file(ids, np.array([4]), np.array([True]), np.array([n])))
        assert file.ids().tolist() == ids.tolist()
        for at in rng.integers(0, n, 50) if n else ():
            assert file.access(int(at)) == ids[at]
            token = int(ids[at])
            where = np.flatnonzero(ids == token)
            assert file.count(token) == len(where) and file.rank(token, int(at)) == (where < at).sum()
            assert [file.select(token, k) for k in range(len(where))][:5] == where.tolist()[:5]
            assert file.select(token, len(where)) == -1
        assert file.count(60_000) == 0 and file.select(60_000, 0) == -1


def check_packing(rows, expected, size):
    """Pieces cover every document once, sequences are gapless, and little is padded."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(expected)
    for doc_id, found in docs.items():
        at, ids = 0, expected[doc_id]
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padded = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded


def test_packing_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], docs.schema))
    expected = {d.doc_id: plain("word_bpe_49k.json", d.text) + [2] for d in docs.collect()}
    assert check_packing(packing.pack(docs).collect(), expected, 4096) == 0
    assert check_packing(packing.pack(docs, size=64, group_tokens=1000).collect(), expected, 64) == 0


def test_packing_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (1, "a"), (1, "a")], "doc_id long, text string")
    assert packing.pack(docs).count() >= 4
    assert packing.pack(docs.limit(0)).count() == 0


def test_first_fit_is_first_fit():
    random.seed(3)
    for _ in range(200):
        pieces = [(i, 0, random.randrange(1, 20)) for i in range(random.randrange(30))]
        bins = []
        for piece in sorted(pieces, key=lambda p: (-p[2], p[0])):
            at = next((b for b in bins if sum(p[2] for p in b) + piece[2] <= 20), None)
            if at is None:
                bins.append(at := [])
            at.append(piece)
        assert packing.first_fit_decreasing(pieces, 20) == bins


def test_pieces_of_any_shape_and_a_table_that_starts_anew(monkeypatch):
    """Small tables, small batches and hashes that collide give the same ids."""
    from quern.llm import tokens

    random.seed(9)
    bits = ["word", "Word,", "a", "\n", "x1", "é", "Été!", "<|endoftext|>", "abc<|", "<", "  ", "\t", "naïve", "日本", "don't", "...", "(a)",
            "ß", "\xa0", "×", "a×", "--", '"hi"', "e-mail", "1,000", "\r\n", "l'été", "÷", "　", "\x1c"]
    texts = ["".join(random.choice(bits) + random.choice([" ", " ", "\n", ""]) for _ in range(random.randrange(12))) for _ in range(700)]
    for name, kind in (("byte_bpe_50k.json", ("<|endoftext|>", True)), ("word_bpe_49k.json", ("<|startoftext|>", False))):
        path, tokenizer = public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        for change in ({}, {"_LEARN_CHARS": 300}, {"_MIX": np.uint64(1 << 61)}):
            with monkeypatch.context() as m:
                for key, value in change.items():
                    m.setattr(tokens, key, value)
                encoder = tokens.Encoder(path, *kind, table_pieces=100 if change else 10**6)
                assert list(encoder.batch(texts)) == want == list(encoder.batch(texts)), (name, change)


def test_wavelet_file_of_several_blocks_reads_only_what_it_needs():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50257, 150_000)
    raw = wavelet.encode_file(ids, np.array([4, 5]), np.array([True, False]), np.array([100_000, 50_000]))
    file = wavelet.WaveletFile(raw)
    assert file.access(140_000) == ids[140_000] and len(file._held) == file.planes
    assert file.doc_ids[0] == 4 and file.has_id.tolist() == [True, False] and file.lengths.tolist() == [100_000, 50_000]
    token = int(ids[77])
    where = np.flatnonzero(ids == token)
    assert [file.select(token, k) for k in range(len(where))] == where.tolist()
    assert file.rank(token, 131_072) == (where < 131_072).sum() and (file.ids() == ids).all()


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, None)] * 4000, "doc_id long, text string")
    for run in (wavelet.encode_documents, packing.pack):
        assert run(docs).count() == 4000
    shards = wavelet.write_shards(docs).groupBy("part").sum("n_tokens").collect()
    assert len(shards) > 4 and max(s[1] for s in shards) < 2000
    sequences = packing.pack(docs, size=8).selectExpr("sequence_id >> 40 as part").groupBy("part").count().collect()
    assert len(sequences) > 4 and max(s["count"] for s in sequences) < 2000


def test_pieces_alike_in_their_first_bytes():
    """Pieces of 16 bytes and more that share a beginning, a length or a kind are told apart, met again or after many others."""
    from quern.llm import tokens

    random.seed(4)
    stem = "abcdefghijklmnop"
    words = [stem[:n] + end for n in (14, 15, 16) for end in ("", "q", "r", "qs", "qt", "q!", "r!", ".", "é", "è", "日", "本", "<", "q<|endoftext|>")]
    words += [stem + "x" * n + end for n in (1, 40, 5000) for end in "yzé1"] + ["", "a", "\x00", "a\x00", "\x00a", "'s", "<a", "(a)", "É", "\x00" * 17]
    texts = ["", "\n", "a\n", "\na", "<a", "é", "'s a", stem, stem + "\n" + stem, "a\x1cb", " a", "a "]
    texts += [random.choice(" \n").join(random.choice(words) for _ in range(random.randrange(9))) for _ in range(600)]
    texts += ["\n".join("".join(random.choice("aeioulrst") for _ in range(7)) for _ in range(9000))]
    for name, kind in (("byte_bpe_50k.json", ("<|endoftext|>", True)), ("word_bpe_49k.json", ("<|startoftext|>", False))):
        encoder = tokens.Encoder(public_tokenizers.path(name), *kind)
        want = [np.array(plain(name, t), "<u4").tobytes() for t in texts]
        for given in (texts, texts[::-1], [t.encode() for t in texts]):
            got = list(encoder.batch(given))
            assert (got if given[0] == texts[0] or given[0] == b"" else got[::-1]) == want


def test_pieces_met_before_are_found_without_sorting(spark, monkeypatch):
    """Sorting all pieces of each run of texts was most of the time for texts whose words are known."""
    from quern.llm import tokens

    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    encoder, sorted_items, unique = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>", True), [], np.unique
    want = list(encoder.batch(texts))
    monkeypatch.setattr(np, "unique", lambda items, *args, **kw: sorted_items.append(len(items)) or unique(items, *args, **kw))
    assert list(encoder.batch(texts)) == want
    assert sum(sorted_items) < sum(len(t.split()) for t in texts) / 10


def test_planes_are_moved_block_by_block():
    """Building and reading a file hold its ids twice, not lists of places for all of them."""
    import tracemalloc

    ids = np.random.default_rng(3).integers(0, 50257, 1_000_000).astype("<u4")

    def most(run):
        tracemalloc.start()
        found = run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak / len(ids)

    one = np.array([1])
    raw, built = most(lambda: wavelet.encode_file(ids, one, one > 0, one * len(ids)))
    back, read = most(wavelet.WaveletFile(raw).ids)
    # Two bytes an id twice, the ones that wait, and the file in parts and whole.
    assert built < 9.5 and read < 5 and (back == ids).all(), (built, read)
