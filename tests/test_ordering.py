import random

import pytest
from rows import values
from pyspark.sql import functions as F

from quern.operators.ordering import previous_values, row_rank, running_total


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    groups = ["hot"] * 400 + ["a"] * 30 + ["b"] + [None] * 60
    data = [(g, random.randrange(20), i, random.randrange(-5, 6)) for i, g in enumerate(groups)]
    return spark.createDataFrame(data, "g string, rank int, id int, v int").cache()


@pytest.mark.parametrize("partition", [["g"], []])
@pytest.mark.parametrize("ranges", [None, 70])
def test_cut_ranges_give_what_one_window_gives(rows, partition, ranges):
    order = ["rank", "id"]
    whole = running_total(rows, F.col("v"), "t", partition, order, 1)
    assert values(running_total(rows, F.col("v"), "t", partition, order, ranges)) == values(whole)
    whole = row_rank(rows, "r", partition, order, 1)
    assert values(row_rank(rows, "r", partition, order, ranges)) == values(whole)
    whole = previous_values(rows, {"last_v": "v", "last_id": "id"}, partition, order, 1)
    found = previous_values(rows, {"last_v": "v", "last_id": "id"}, partition, order, ranges)
    assert values(found) == values(whole)


def test_null_values_and_empty_input(spark, rows):
    some = rows.withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    whole = running_total(some, F.col("v"), "t", ["g"], ["rank", "id"], 1)
    assert values(running_total(some, F.col("v"), "t", ["g"], ["rank", "id"], 50)) == values(whole)
    assert running_total(rows.where("false"), F.col("v"), "t", ["g"], ["id"], 9).count() == 0
