import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F
from rows import values

from quern.functions.numeric import exact_sum, round2


def test_round2_goes_by_the_exact_binary_value(spark):
    draw = random.Random(6)
    numbers = [2.135, 0.125, 0.375, 2.675, 1.005, -1.005, -0.125, 0.0, -0.001, 1e15 + 0.3, 1e300, 4503599627370495.5 / 64]
    numbers += [draw.randrange(-(10**6), 10**6) / 1000 for _ in range(2000)] + [draw.randrange(-999, 999) / 8 for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    exact = lambda x: float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) if abs(x) < 1e20 else x
    found = df.select("x", round2(F.col("x"))).collect()
    assert [(x, y) for x, y in found] == [(x, exact(x)) for x, _ in found]
    assert dict(found)[2.135] == 2.13 and dict(found)[0.125] == 0.12 and dict(found)[0.375] == 0.38


def test_round2_of_odd_numbers(spark):
    df = spark.createDataFrame([(None,), (math.inf,), (-math.inf,), (math.nan,)], "x double")
    found = [r[0] for r in df.select(round2(F.col("x"))).collect()]
    assert found[:3] == [None, math.inf, -math.inf] and math.isnan(found[3])


@pytest.fixture(scope="module")
def summands(spark):
    draw = random.Random(7)
    rows = [(i % 3, draw.uniform(-1, 1) * 10 ** draw.randrange(-12, 12)) for i in range(9000)]
    rows += [(3, 1e20), (3, 1.0), (3, -1e20), (4, -1e-10), (4, None), (5, -0.1), (5, -0.2), (6, 2.0**95), (6, -(2.0**95)), (6, 2.0**-90)]
    return rows, spark.createDataFrame(rows, "k int, x double")


@pytest.mark.parametrize("parts", [1, 211])
def test_sums_are_exact_in_any_order(summands, parts):
    rows, df = summands
    found = dict(values(df.repartition(parts).groupBy("k").agg(exact_sum(F.col("x")))))
    assert found == {k: math.fsum(x for g, x in rows if g == k and x is not None) for k in found} and len(found) == 7


def test_sums_of_none_and_of_infinities(spark):
    df = spark.createDataFrame([(0, None), (1, math.inf), (1, 2.0), (2, math.inf), (2, -math.inf)], "k int, x double")
    found = dict(values(df.groupBy("k").agg(exact_sum(F.col("x")))))
    assert found[0] is None and found[1] == math.inf and math.isnan(found[2])
