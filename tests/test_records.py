from bisect import bisect_left

import pytest
from rows import values
from pyspark.sql import functions as F

from quern.operators import records
from quern.sources.sinks import tera_sink
from quern.sources.text import read_tera, tera_source

FIRST_KEYS = [".t^#\\|v$2\\", "75@~?'WdUF", "w[o||:N&H,"]


def generated(spark, rows, parts=None):
    return records.teragen(records.row_range(spark, rows, parts))


def plain_keys(n):
    """Keys by walking the generator one step at a time."""
    state, keys = 0, []
    for _ in range(n):
        text = ""
        for _ in range(3):
            state = (state * 3141592621 + 663896637) % 2**32
            digits = state // 52
            text += "".join(chr(32 + digits // 95**p % 95) for p in (3, 2, 1, 0))
        keys.append(text[:10])
    return keys


def test_keys_and_layout(spark):
    rows = generated(spark, 300).collect()
    assert [r.key for r in rows[:3]] == FIRST_KEYS
    assert [r.key for r in rows] == plain_keys(300)
    assert all(len(r.key + r.value) == 98 for r in rows)
    assert [r.value[:10] for r in rows[:2]] == ["         0", "         1"]
    assert rows[1].value[10:] == "".join(c * 10 for c in "IJKLMNO") + "P" * 8


def test_large_row_ids(spark):
    found = records.teragen(spark.createDataFrame([(2**31 + 5,)], "row_id bigint")).first()
    assert found.value[:10] == str(5 - 2**31)[:10]


def test_rows_do_not_depend_on_the_partitions(spark):
    assert values(generated(spark, 500, 1)) == values(generated(spark, 500, 7))


def test_sort_is_a_permutation_and_validates(spark, folder):
    rows = generated(spark, 2000, 4)
    tera_sink(records.terasort(rows, 5), folder + "/sorted")
    back = read_tera(spark, folder + "/sorted")
    assert back.select("file").distinct().count() == 5
    assert values(back.select("key", "value")) == values(rows)
    assert records.teravalidate(back, order=("block", "pos")).count() == 0


def test_short_lines_are_all_key(spark, lines):
    assert values(tera_source(lines("abc", "0123456789xyz"))) == [("0123456789", "xyz"), ("abc", "")]


FILES = "file string, pos int, key string"


@pytest.mark.parametrize("ranges", [1, 3])
def test_validation_reports(spark, ranges):
    def report(*rows):
        df = spark.createDataFrame(rows, FILES)
        return [e for (e,) in values(records.teravalidate(df, ranges=ranges))]

    in_order = [("f0", 0, "a"), ("f0", 1, "b"), ("f0", 2, "b"), ("f1", 0, "b"), ("f1", 1, "c"), ("f1", 2, "d")]
    assert report(*in_order) == []
    swapped = [("f0", 0, "a"), ("f0", 1, "c"), ("f0", 2, "b"), ("f0", 3, "d"), ("f1", 0, "e")]
    assert report(*swapped) == ["misorder in f0 last: 'c' current: 'b'"]
    overlap = [("f0", 0, "a"), ("f0", 1, "m"), ("f0", 2, "n"), ("f1", 0, "b"), ("f1", 1, "z")]
    assert report(*overlap) == ["misordered keys last: f0:end 'n' current: f1:begin 'b'"]


@pytest.mark.parametrize("ranges", [1, 20])
def test_places_are_the_sorted_order(spark, ranges):
    rows = generated(spark, 700)
    found = records.sorted_places(rows, ranges=ranges).orderBy("place").collect()
    assert [r.place for r in found] == list(range(1, 701))
    assert [r.key for r in found] == sorted(plain_keys(700))


def test_range_partition_puts_equal_keys_low(spark, lines):
    splits = ["b", "d", "f"]
    keys = ["a", "b", "c", "d", "e", "f", "g"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert values(records.range_partition(df, splits)) == [(k, bisect_left(splits, k)) for k in keys]


def test_split_points_are_evenly_spaced(spark):
    rows = generated(spark, 1000)
    found = values(records.range_split_points(rows, 4))
    ordered = sorted(plain_keys(1000))
    assert found == [(i, ordered[250 * i]) for i in (1, 2, 3)]
    sampled = records.range_split_points(rows, 4, sample_rows=100)
    assert values(sampled) == values(records.range_split_points(rows.repartition(3), 4, sample_rows=100))


def test_a_hot_key_is_spread(spark):
    df = spark.range(4000).select(F.lit("same").alias("key"), F.format_string("%05d", "id").alias("value"))
    parts = records.terasort(df, 8).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2000
