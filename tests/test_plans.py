"""What the plans must keep to at scale, read from the plans themselves."""

import re

import pytest
from pyspark.sql import functions as F

from quern.operators import jobs, ordering, text
from quern.plans.queries import QUERIES
from quern.plans.views import view

FOLDER = "/root/testdata/sf0.001"
READ = {
    "word_count": {"text"},
    "sequence_count": {"text", "source"},
    "inverted_index": {"text", "doc_id"},
    "term_vector": {"text", "source"},
    "adj_list": {"l_partkey", "l_suppkey"},
    "self_join": {"l_orderkey", "l_returnflag", "l_partkey"},
    "histogram_ratings": {"l_orderkey", "l_suppkey", "l_linenumber", "o_orderkey"},
    "histogram_movies": {"l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "o_orderkey"},
    "teragen": {"o_orderkey"},
    "feasibility": {"o_custkey", "o_orderkey"},
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(READ))
def test_only_the_needed_columns_are_read(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, FOLDER)))
    assert {c.split(":")[0] for s in schemas for c in s.split(",")} == READ[name]


def test_filters_reach_the_scan(spark):
    assert "In(l_partkey, [101,128,150,17,199,42,5,77])" in plan(view(spark, FOLDER, "centroids"))


@pytest.mark.parametrize("name", ["word_count", "inverted_index", "self_join", "adj_list", "classify", "kmeans_update", "backlog_rrh", "priority_share"])
def test_no_pairing_of_all_rows_and_no_python_workers(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoop|Python|Arrow", plan(QUERIES[name](spark, FOLDER)))


def test_groups_are_combined_before_the_shuffle(spark):
    found = plan(text.word_count(spark.read.parquet(FOLDER + "/documents.parquet")))
    assert found.count("partial_count") == 1


def test_word_count_shuffles_only_its_counts(spark):
    assert plan(QUERIES["word_count"](spark, FOLDER)).count("Exchange") == 1


def test_a_cut_order_brings_no_large_group_into_one_task(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("g"), "id", F.lit(1).alias("v"))
    cut = ordering.in_order(rows, ["g"], ["id"], ranges=10)
    sizes = [r["count"] for r in cut.frame.groupBy("_group", "_bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1500


def test_small_totals_are_sent_to_the_rows(spark):
    found = plan(jobs.priority_share(view(spark, FOLDER, "job_snapshots")))
    assert "BroadcastHashJoin" in found and "Window" not in found


def test_larger_sides_are_shuffled(spark, monkeypatch):
    from quern.operators import skew

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = spark.range(5), spark.range(50)
        assert "BroadcastHashJoin" in plan(large.join(skew.checked_broadcast(small, 10), "id"))
        assert "SortMergeJoin" in plan(large.join(skew.checked_broadcast(large, 10), "id"))
        wide = small.withColumn("text", F.repeat(F.lit("x"), 1000)).withColumn("list", F.array(F.lit(1), F.lit(2)))
        assert "SortMergeJoin" in plan(large.join(skew.checked_broadcast(wide, 10, max_bytes=2000), "id"))
        assert "BroadcastHashJoin" in plan(large.join(skew.checked_broadcast(wide, 10, max_bytes=100_000), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
