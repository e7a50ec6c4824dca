from rows import values

from quern.sources.quarantine import split_reviews

LINES = ["7:1_4,2_x,5,,3_ 1", "nocolon", ":1_3", "m:1_1", "8:", "9:+1_-2,1_5.0,9999999999_1,_4,1_2_3", None, ""]


def test_every_token_is_good_or_bad(spark, lines, folder):
    found = split_reviews(lines(*LINES), folder + "/strict", require_rater=True)
    assert values(found.good) == [(7, 0, 1, 4), (9, 0, 1, -2)]
    assert values(found.bad) == sorted(
        [
            ("7", 1, "2_x", "rating is no number"), ("7", 2, "5", "no rater"), ("7", 3, "3_ 1", "rating is no number"),
            (None, None, "nocolon", "no movie"), (None, None, ":1_3", "no movie"), (None, None, "m:1_1", "movie is no number"),
            ("9", 1, "1_5.0", "rating is no number"), ("9", 2, "9999999999_1", "rater is no number"), ("9", 3, "_4", "rater is no number"),
            ("9", 4, "1_2_3", "rating is no number"), (None, None, None, "no movie"), (None, None, "", "no movie"),
        ],
        key=repr,
    )


def test_raters_count_only_where_asked(spark, lines, folder):
    found = split_reviews(lines(*LINES), folder + "/ratings")
    assert values(found.good) == sorted([(7, 0, 1, 4), (7, 2, None, 5), (9, 0, 1, -2), (9, 2, None, 1), (9, 3, None, 4)], key=repr)
    assert {r.reason for r in found.bad.collect()} == {"rating is no number", "no movie", "movie is no number"}


def test_an_empty_frame(spark, lines, folder):
    found = split_reviews(lines("1:1_1").where("false"), folder + "/none")
    assert values(found.good) == values(found.bad) == []


def test_the_lines_are_read_once(spark, folder):
    """The count of rows that pass an accumulator-like observation is the number of lines."""
    from quern.operators.counters import counted

    spark.createDataFrame([(f"{i}:1_1,x_y",) for i in range(100)], "value string").write.text(folder + "/lines")
    seen, count = counted(spark.read.text(folder + "/lines"), "lines")
    found = split_reviews(seen, folder + "/split")
    assert found.good.count() == found.bad.count() == 100 and count.get == {"lines": 100}
