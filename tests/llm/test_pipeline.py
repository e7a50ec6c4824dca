import re
import sys
from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_near_join import plain as plain_near
from test_quality import plain as plain_quality
from tokenizers import Tokenizer

from quern.llm import exact_dedup, mixing, near_join, quality
from quern.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, FOLDER, "documents")
    columns, steps = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-stage-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        steps.append(docs.collect())
    raw, good, single, apart, mixed, packed = steps

    verdict = {r.doc_id: r.kept for r in quality.quality(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()}
    assert sorted(good) == sorted(r for r in raw if verdict[r.doc_id])
    assert not any(plain_quality(r.text)[-1] for r in good)

    first = {}
    for r in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    assert sorted(single) == sorted(first.values()) and len(single) < len(good)

    classes = plain_near([(r.doc_id, r.text) for r in single])
    assert sorted(apart) == sorted(r for r in single if classes[r.doc_id][1] == r.doc_id) and len(apart) < len(single)

    want = {r.doc_id: r.taken for r in mixing.taken(spark.createDataFrame(apart)).collect()}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert words == {d: n for d, n in want.items() if n}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r.length for r in packed) == tokens
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in fill.values())
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in mixed)


def test_the_entry_module_has_every_numbered_query():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_decide_by_row_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (5, 6)]
    other = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, near[0]), (None, near[1]), (None, other[0]), (7, other[1]), (7, other[2]), (7, near[0] + " "), (9, other[3]),
            (9, other[3]), (9, other[3] + " "), (None, None)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    found = near_join.keep_one(docs).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in found if r.doc_id != 9) == sorted(
        [(0, other[0]), (0, ""), (7, other[1]), (7, other[2]), (7, near[0] + " ")]
    )
    assert sum(r.doc_id == 9 for r in found) == 1 and len(found) == 6

    want = Counter(r.taken for r in mixing.taken(docs).collect() if r.taken)
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id, r.text.split()[0]] += len(r.text.split())
    assert sum(mixed.values()) == sum(t * n for t, n in want.items()) and len(mixed) >= 6

    good = table(spark, FOLDER, "documents")
    model = quality.quality(good, table(spark, FOLDER, "labels")).collect()
    kept = next(r.doc_id for r in model if r.kept)
    text = good.where(f"doc_id = {kept}").first().text
    extra = spark.createDataFrame([(kept, "bad"), (None, "bad"), (None, text)], "doc_id long, text string")
    both = good.select("doc_id", "text").unionByName(extra)
    stay = quality.keep_good(both, table(spark, FOLDER, "labels").where(f"doc_id <> {kept}")).collect()
    assert all(r.text != "bad" for r in stay) and sum(r.doc_id is None for r in stay) == sum(r.doc_id == kept for r in stay)


def test_rows_are_judged_by_their_own_keys_with_clashing_columns(spark):
    """Shared and missing ids with other texts, helper names as columns, and a map column."""
    schema = "doc_id long, text string, source string, _row int, _keep int, class_name string, file string, name string, row int, more map<string,int>"
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "ABC"]
    rows = [(3, long[0]), (5, long[0]), (5, long[1]), (None, long[0]), (None, long[2]), (None, long[2]), (6, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "s", 1, 2, "c", "f", "n", 3, {"k": i}) for i, (d, t) in enumerate(rows)], schema)
    for keep in (exact_dedup.drop_duplicates, near_join.keep_one):
        found = keep(docs)
        assert found.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
        assert kept == sorted([(3, long[0]), (5, long[1]), (None, long[2]), (6, "")], key=repr)
        assert keep(docs.where("false")).collect() == []
    stay = quality.keep_good(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert stay.columns == docs.columns and all(r.text for r in stay.collect())
