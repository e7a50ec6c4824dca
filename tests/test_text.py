from collections import Counter

from rows import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.text import after_last_comma, before_last_comma, lines as line_column, tokens
from quern.operators import text


def documents(spark, *rows):
    return spark.createDataFrame(rows, "doc string, text string")


def test_tokens_keep_case_and_punctuation(spark):
    df = spark.createDataFrame([(" a\t\tb\fA. ",), ("",), (" \n",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["a", "b", "A."], [], []]


def test_lines_like_a_line_reader(spark):
    df = spark.createDataFrame([("a\r\nb\rc\nd\n",), ("",), ("\n",), ("x\n\ny",)], "t string")
    found = [r[0] for r in df.select(line_column(F.col("t"))).collect()]
    assert found == [["a", "b", "c", "d"], [], [""], ["x", "", "y"]]


def test_last_comma(spark):
    df = spark.createDataFrame([("a,b,c",), ("a",), (",",)], "t string")
    found = df.select(before_last_comma(F.col("t")), after_last_comma(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [("a,b", "c"), (None, None), ("", "")]


def test_sequences_stay_inside_a_line(spark):
    df = documents(spark, ("D", "a b\nc d e f"), ("E", "c d e\nx"))
    found = text.sequence_count(text.text_lines(df, keep=("doc",)), "doc")
    assert values(found) == [("c", "d", "e", "D", 1), ("c", "d", "e", "E", 1), ("d", "e", "f", "D", 1)]


def test_term_vector_cuts_and_orders(spark):
    df = documents(spark, ("h", "x " * 10 + "y " * 9 + "p:q " * 11), ("g", "z " * 10 + "a " * 10))
    found = [(r.host, r.term) for r in text.term_vector(df, "doc").collect()]
    assert found == [("g", "a:10"), ("g", "z:10"), ("h", "p:q:11"), ("h", "x:10")]


def test_inverted_index_has_each_pair_once(spark):
    df = documents(spark, ("D1", "a a b"), ("D2", "a"), ("D1", "b"))
    assert values(text.inverted_index(df, "doc")) == [("a", "D1"), ("a", "D2"), ("b", "D1")]


def test_long_lists_are_blocks_that_hold_every_document_once(spark):
    df = documents(spark, *[(f"D{i:03}", "hot cold" if i % 9 == 0 else "hot") for i in range(200)])
    found = text.inverted_index_list(df, "doc", list_rows=30).collect()
    assert {r.block for r in found if r.word == "cold"} == {0}
    hot = [r for r in found if r.word == "hot"]
    assert len(hot) > 1 and all(r.docs == sorted(r.docs) and len(r.docs) == r.n_docs for r in hot)
    assert sorted(d for r in hot for d in r.docs) == [f"D{i:03}" for i in range(200)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té.", max_size=30), min_size=1, max_size=6))
def test_word_count_against_plain_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = Counter(w for t in texts for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w)
    assert dict(values(text.word_count(df))) == dict(plain)


def test_counters_are_observed_with_the_job(spark):
    from quern.operators.counters import counted

    df = spark.createDataFrame([("a b a",), ("c",)], "text string")
    observed, metrics = counted(text.words(df), "words")
    assert observed.groupBy("word").count().count() == 3
    assert metrics.get == {"words": 4}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rare_triples_are_not_combined_before_the_shuffle(spark):
    """Below the exchange that deals them there is no table of a whole task's keys."""
    found = text.sequence_count(text.text_lines(documents(spark, ("D", "a b c")), keep=("doc",)), "doc")
    above, below = physical(found).split("Exchange hashpartitioning", 1)
    assert "HashAggregate" in above and "Aggregate" not in below and "Exchange" not in below


def test_texts_split_at_every_kind_of_break(spark):
    df = spark.createDataFrame([("\r\r\na\n\r",), ("a b\t\r\nc\fd \x0be f\r",), (None,)], "t string")
    found = [tuple(r) for r in df.select(line_column(F.col("t")), tokens(F.col("t"))).collect()]
    assert found == [(["", "", "a", ""], ["a"]), (["a b\t", "c\fd \x0be f"], ["a", "b", "c", "d", "\x0be f"]), ([], None)]


def test_null_docs_and_texts_keep_their_rows(spark):
    df = documents(spark, (None, "a b c\na b c"), (None, "a b c"), ("D", None), ("D", "a b c"))
    found = text.sequence_count(text.text_lines(df, keep=("doc",)), "doc").collect()
    assert sorted((tuple(r)[:3], r.doc or "", r.n) for r in found) == [(("a", "b", "c"), "", 3), (("a", "b", "c"), "D", 1)]
    lists = [(r.word, r.n_docs) for r in text.inverted_index_list(df.where("doc is not null"), "doc", list_rows=1).collect()]
    assert sorted(lists) == [("a", 1), ("b", 1), ("c", 1)]


def test_sizes_of_words_are_joined_without_a_sort(spark):
    plan = physical(text.inverted_index_list(documents(spark, ("D", "a b")), "doc", list_rows=1))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_groups_are_split_into_blocks(spark):
    df = documents(spark, (None, "x"), (None, "y"), ("D", "x"))
    from quern.operators.skew import with_blocks

    blocked = with_blocks(df, ["doc"], F.col("text"), 1).collect()
    assert sorted((r.doc or "", r._blocks) for r in blocked) == [("", 2), ("", 2), ("D", 1)]
