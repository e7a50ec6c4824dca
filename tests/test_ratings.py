import math
import struct

import pytest
from pyspark.sql import functions as F
from rows import values

from quern.operators import clustering, ordering, ratings
from quern.sources.sinks import model_sink
from quern.sources.text import centroid_source, movie_source

REVIEWS = "movie_id bigint, pos int, rater_id int, rating int"


def test_histogram_of_ratings(spark, lines):
    movies = movie_source(lines("7:1_4,2_4,5", ":1_3", "nocolon"))
    assert values(ratings.histogram_ratings(ratings.flatten_reviews(movies))) == [(4, 2), (5, 1)]


def test_bad_ratings_fail_or_are_null(spark, lines):
    df = lines("7:1_x")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ratings.histogram_ratings(ratings.flatten_reviews(movie_source(df))).collect()
    assert values(ratings.histogram_ratings(ratings.flatten_reviews(movie_source(df, permissive=True)))) == []


@pytest.mark.parametrize("nested", [True, False])
def test_bins_are_upper_edges(spark, lines, nested):
    movies = movie_source(lines("1:1_4,2_4", "2:1_5", "3:" + ",".join(["1_3"] * 51 + ["1_4"] * 49), "9:"))
    if nested:
        found = ratings.histogram_movies_nested(movies)
    else:
        found = ratings.histogram_movies(ratings.flatten_reviews(movies))
    assert values(found) == [(0.0, 1), (3.5, 1), (4.5, 1), (5.5, 1)]


def model(spark, *rows):
    """Rows (k, movie, total, reviews), or with the reviews before them (k, movie, total, start, reviews)."""
    return spark.createDataFrame([(r[0], 0.0, r[1], r[2], r[3] if len(r) > 4 else 0, r[-1]) for r in rows], clustering.MODEL_SCHEMA)


def test_centroids_are_numbered_capped_and_without_repeats(spark):
    df = model(spark, (0, 10, 3, "1_1,1_5,2_2"), (1, 30, 2, "7_3,8_4,9_5"), (2, 20, 1, "5_5"), (3, -1, 0, ""))
    found = values(clustering.load_centroids(df))
    assert found == [(0, 7, 3), (0, 8, 4), (1, 5, 5), (2, 1, 1), (2, 2, 2)]


@pytest.mark.parametrize("clusters", [8, 300])
def test_models_of_any_size(spark, clusters):
    """Movie i has the ratings of centroid i alone, on raters of its own and one that all share."""
    order = sorted(range(clusters), reverse=True)
    rated = {m: {0: 1 + m % 5, m + 1: 5} for m in range(clusters)}
    rows = [(m, 0, r, v) for m, own in rated.items() for r, v in own.items()]
    reviews = spark.createDataFrame(rows, REVIEWS)
    centroids = clustering.load_centroids(clustering.initial_model(reviews, list(range(clusters)), ("rater_id",)))
    found = dict(values(clustering.classify(reviews, centroids)))
    score = lambda a, b: math.fsum(rated[a][r] * rated[b][r] for r in rated[a] if r in rated[b])
    assert set(found) == set(range(clusters)) and set(found.values()) <= set(range(clusters))
    # All centroids share one rater, so every similarity is 1.0 and the lowest cluster wins.
    assert set(found.values()) == {0} and order[0] == clusters - 1 and score(0, 0) > 0
    apart = reviews.where("rater_id > 0")
    own = clustering.load_centroids(clustering.initial_model(apart, list(range(clusters)), ("rater_id",)))
    assert dict(values(clustering.classify(apart, own))) == {m: k for k, m in enumerate(order)}


def test_ties_go_to_the_lowest_cluster_and_strangers_to_cluster_0(spark):
    centroids = clustering.load_centroids(model(spark, (0, 30, 1, "1_4"), (1, 20, 1, "1_2"), (2, 10, 2, "2_3,3_1")))
    reviews = spark.createDataFrame(
        [(1, 0, 1, 5), (2, 0, 99, 5), (3, 0, 2, 3), (3, 1, 3, 1), (4, 0, None, None)], REVIEWS
    )
    assert values(clustering.classify(reviews, centroids)) == [(1, 0), (2, 0), (3, 2), (4, 0)]
    assert values(clustering.kmeans_assign(reviews, centroids)) == [(1, 0, 1.0), (2, 0, 0.0), (3, 2, 1.0), (4, 0, 0.0)]


def test_scores_take_common_raters_only_and_repeats_of_the_movie(spark):
    centroids = clustering.load_centroids(model(spark, (0, 30, 3, "1_4,2_1,3_5")))
    reviews = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 1, 2), (1, 2, 2, 5), (1, 3, 77, 5)], REVIEWS)
    (movie, k, similarity), = values(clustering.cosine_scores(reviews, centroids))
    expected = (2 * 4 + 2 * 4 + 5) / math.sqrt((4 + 4 + 25) * (16 + 16 + 1))
    assert (movie, k) == (1, 0) and similarity == pytest.approx(expected, abs=1e-6)


def test_winner_is_nearest_to_the_average(spark):
    rows = [(1, 0, 0.2), (2, 0, 0.5), (3, 0, 0.9), (5, 1, 0.25), (4, 1, 0.25)]
    assigned = spark.createDataFrame(rows, "movie_id bigint, cluster int, similarity float")
    found = values(clustering.cluster_winners(assigned).select("cluster", "members", "movie_id"))
    assert found == [(0, 3, 2), (1, 2, 4)]


def test_long_lines_stay_whole_with_and_without_the_line(spark, lines):
    body = ",".join(f"{100 + i}_{1 + i % 5}" for i in range(400))
    movies = movie_source(lines(f"12:{body}", "13:5_1"), require_underscore=True)
    assigned = spark.createDataFrame([(12, 0, 0.5), (13, 1, 0.1)], "movie_id bigint, cluster int, similarity float")
    flat = clustering.kmeans_update(assigned, ratings.flatten_reviews(movies))
    whole = clustering.kmeans_update_lines(assigned, movies)
    for found in (flat, whole):
        first = {r.k: r for r in found.collect()}
        assert first[0].reviews == body and first[0].total == 400
        assert first[1].reviews == "5_1" and first[1].total == 1


def test_members_keep_their_line(spark, lines):
    movies = movie_source(lines("12:1_1,2_2"))
    assigned = spark.createDataFrame([(12, 3, 0.5)], "movie_id bigint, cluster int, similarity float")
    assert values(clustering.kmeans_members(assigned, movies)) == [(3, "12:1_1,2_2")]


def test_model_file_round_trip(spark, folder):
    df = model(spark, (0, 30, 2, "1_4,2_1"), (1, 20, 1, "3_2"))
    model_sink(df, folder + "/model")
    assert values(centroid_source(spark, folder + "/model")) == values(df)


def test_blocks_of_a_centroid_are_one_list(spark):
    """Blocks in any order; the first review of a rater over all blocks wins, and none past the total counts."""
    df = model(spark, (1, 7, 5, 3, "3_1,1_9,4_4"), (0, 7, 1, "9_9"), (1, 7, 5, 0, "1_1,2_2,1_3"), (0, 9, 2, "5_5,6_6"))
    assert values(clustering.load_centroids(df)) == [(0, 5, 5), (0, 6, 6), (1, 9, 9), (2, 1, 1), (2, 2, 2), (2, 3, 1)]


def test_model_file_of_blocks_and_of_one_line(spark, folder, lines):
    df = model(spark, (0, 30, 5, "1_4,2_1"), (0, 30, 5, 2, "7,8_1"), (0, 30, 5, 4, "9_1"), (1, 20, 0, ""))
    model_sink(df, folder + "/model")
    assert values(centroid_source(spark, folder + "/model")) == values(df)
    lines("0\t0.5 30 2 1_4,2_1", "", "1 0.25\t20 0", "2 0 11 1 5").write.text(folder + "/old")
    found = centroid_source(spark, folder + "/old")
    assert values(found) == [(0, 0.5, 30, 2, 0, "1_4,2_1"), (1, 0.25, 20, 0, 0, ""), (2, 0.0, 11, 1, 0, "5")]


def test_a_movie_with_a_third_of_all_reviews_is_spread(spark, folder):
    """The winners' reviews come in blocks in order, and no task of the ranked rows holds more than twice the median."""
    hot = [(1, i, i % 5000, 1 + i % 5) for i in range(12_000)]
    rows = hot + [(2 + i % 400, i, i % 300, 1 + i % 5) for i in range(24_000)]
    reviews = spark.createDataFrame(rows, REVIEWS)
    assigned = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5), (3, 2, 0.25)], "movie_id bigint, cluster int, similarity float")
    order = ("rater_id", "pos", "rating")
    made = clustering.kmeans_update(assigned, reviews, order, block_rows=100)
    found = made.withColumn("part", F.spark_partition_id()).collect()
    for k, movie in ((0, 1), (1, 2), (2, 3)):
        blocks = sorted((r.start, r.reviews) for r in found if r.k == k)
        wanted = [f"{r}_{v}" for r, _, v in sorted((r, p, v) for m, p, r, v in rows if m == movie)]
        assert ",".join(t for _, t in blocks) == ",".join(wanted)
        assert all(len(t.split(",")) <= 100 and s % 100 == 0 for s, t in blocks)
        assert {r.total for r in found if r.k == k} == {len(wanted)}
    made = ordering.in_order(reviews.where("movie_id = 1").withColumn("k", F.lit(0)), ["k"], ["rater_id", "pos"])
    sizes = sorted(r["count"] for r in made.frame.groupBy("_bucket").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def plain_step(reviews, model):
    """One assign and update in plain Python; reviews and model are {movie: {rater: rating}} with single precision."""
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    order, members = sorted(model, reverse=True), {}
    for movie, rated in reviews.items():
        best = (0.0, 0)
        for k, centroid in enumerate(order):
            both = [(r, model[centroid][p]) for p, r in rated.items() if p in model[centroid]]
            if both:
                norm = f32(math.sqrt(sum(r * r for r, _ in both)) * math.sqrt(sum(c * c for _, c in both)))
                similarity = f32(sum(r * c for r, c in both) / norm)
                if similarity > best[0]:
                    best = (similarity, k)
        members.setdefault(best[1], []).append((movie, best[0]))
    chosen = []
    for group in members.values():
        average = f32(sum(s for _, s in group) / len(group))
        chosen.append(min(group, key=lambda m: (f32(abs(f32(average - m[1]))), m[0]))[0])
    return {m: reviews[m] for m in chosen}


def test_iteration_against_plain_python(spark):
    reviews = {m: {p: 1 + (m * 31 + p * p * 7 + m * p) % 5 for p in range(m % 4, 12)} for m in range(1, 40)}
    rows = [(m, i, p, r) for m, rated in reviews.items() for i, (p, r) in enumerate(rated.items())]
    df = spark.createDataFrame(rows, REVIEWS)
    first = clustering.initial_model(df, [1, 2, 3])
    plain = {m: reviews[m] for m in (1, 2, 3)}
    for _ in range(3):
        plain = plain_step(reviews, plain)
    found = clustering.kmeans_iterate(df, first, max_iter=3).collect()
    assert {r.movie_id for r in found} == set(plain)
    assert all(r.total == len(reviews[r.movie_id]) for r in found)


def test_iteration_says_whether_it_settled(spark):
    rows = [(m, 0, p, 1 + (m * p) % 5) for m in range(1, 30) for p in range(6)]
    df = spark.createDataFrame(rows, REVIEWS)
    first = clustering.initial_model(df, list(range(1, 11)), ("rater_id",))
    short = clustering.kmeans_iterate(df, first, 1, ("rater_id",)).collect()
    long = clustering.kmeans_iterate(df, first, 30, ("rater_id",)).collect()
    assert not short[0].settled and long[0].settled
    again = clustering.kmeans_iterate(df, spark.createDataFrame(long).drop("settled"), 1, ("rater_id",)).collect()
    assert again[0].settled and {r.movie_id for r in again} == {r.movie_id for r in long}
