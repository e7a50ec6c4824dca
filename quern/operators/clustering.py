"""Cosine similarity of movies to centroids, classification and k-means.

The similarity of a movie and a centroid is taken over the raters they share.  Reviews are flat
(movie_id, rater_id, rating); centroids are flat (k, rater_id, c_rating) with one rating per rater, for any number of clusters.
A model has a row per block of a centroid's reviews: k, similarity, movie_id, total (of all blocks), start (reviews in the blocks
before), reviews as ``rater_rating,...``.  No list is ever one value, so a centroid may hold a large share of all reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numeric import exact_sum
from quern.functions.reviews import parse_review
from quern.operators.ordering import row_rank
from quern.operators.skew import checked_broadcast
from quern.session import written

MODEL_SCHEMA = "k int, similarity float, movie_id bigint, total int, start int, reviews string"
# Reviews of a centroid in one row of a model.
MODEL_ROWS = 10_000


def _numbers(model: DataFrame) -> DataFrame:
    """(movie_id, k) -> number of each centroid by falling movie_id; one short row per centroid, without its reviews."""
    heads = model.select("movie_id", "k").distinct()
    return heads.withColumn("number", F.row_number().over(Window.orderBy(F.desc("movie_id"), "k")) - 1)


def load_centroids(model: DataFrame) -> DataFrame:
    """Flat centroids of a model, numbered by falling movie_id.

    Slots with movie_id -1 are empty; only the first ``total`` reviews count, and the first of a
    rater wins, over all blocks.
    """
    used = model.where(F.col("movie_id") != -1)
    numbered = used.join(checked_broadcast(_numbers(used)), ["movie_id", "k"]).withColumn("k", F.col("number"))
    tokens = F.array_remove(F.split("reviews", ","), "")
    flat = numbered.select("k", "total", "start", F.posexplode(tokens).alias("at", "token")).withColumn("pos", F.col("start") + F.col("at"))
    flat = flat.where("pos < total")
    review = parse_review(F.col("token"))
    return (
        flat.select("k", "pos", review.alias("r"))
        .groupBy("k", F.col("r.rater_id").alias("rater_id"))
        .agg(F.min_by("r.rating", "pos").alias("c_rating"))
    )


def _similarities(reviews: DataFrame, centroids: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """(key, k, similarity) per movie and centroid with a rater in common; ``left`` keeps other movies with a null k.

    Sums are combined before the shuffle.  Similarities are single precision, so that ties at 1.0 are exact.
    """
    sums = (
        reviews.select(*key, "rater_id", F.col("rating").cast("bigint").alias("_r"))
        .join(centroids.select("k", "rater_id", F.col("c_rating").cast("bigint").alias("_c")), "rater_id", how)
        .groupBy(*key, "k")
        .agg(
            F.sum(F.col("_r") * F.col("_c")).alias("_rc"),
            F.sum(F.when(F.col("_c").isNotNull(), F.col("_r") * F.col("_r"))).alias("_rr"),
            F.sum(F.when(F.col("_r").isNotNull(), F.col("_c") * F.col("_c"))).alias("_cc"),
        )
    )
    norm = "cast(sqrt(_rr) * sqrt(_cc) as float) as _n"
    ratio = "cast(case when _n > 0 then try_divide(cast(_rc as float), _n) end as float) as similarity"
    return sums.selectExpr(*key, "k", "_rc", norm).selectExpr(*key, "k", ratio)


def cosine_scores(reviews: DataFrame, centroids: DataFrame, key: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """(movie, k) -> similarity, for pairs with a rater in common."""
    return _similarities(reviews, centroids, key, "inner").where(F.col("similarity").isNotNull())


def kmeans_assign(reviews: DataFrame, centroids: DataFrame, key: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """movie -> (cluster, similarity): the highest similarity above 0, the lowest cluster among equals.

    A movie without a common rater goes to cluster 0 with similarity 0.  The outer join keeps such
    movies, so no second pass over the reviews is needed.
    """
    scored = _similarities(reviews, centroids, key, "left")
    candidate = F.when(F.col("similarity") > 0, F.struct("similarity", (-F.col("k")).alias("_k")))
    best = scored.groupBy(*key).agg(F.max(candidate).alias("_best"))
    return best.select(
        *key,
        F.coalesce(-F.col("_best._k"), F.lit(0)).cast("int").alias("cluster"),
        F.coalesce("_best.similarity", F.lit(0).cast("float")).alias("similarity"),
    )


def classify(reviews: DataFrame, centroids: DataFrame, key: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """movie -> cluster."""
    return kmeans_assign(reviews, centroids, key).drop("similarity")


def kmeans_members(assigned: DataFrame, movies: DataFrame) -> DataFrame:
    """(cluster, line) of every member, from movies with their original line."""
    return movies.join(assigned, "movie_id").select("cluster", "line")


def cluster_winners(assigned: DataFrame) -> DataFrame:
    """Per cluster its member count and the movie nearest to the average similarity; ties go to the lowest movie_id."""
    # An exact sum, so that the order of rows never decides which of two movies is nearer.
    total = exact_sum(F.col("similarity").cast("double"))
    averages = assigned.groupBy("cluster").agg((total / F.count("similarity")).cast("float").alias("_average"))
    distance = F.abs(F.col("_average") - F.col("similarity"))
    return (
        assigned.join(averages, "cluster")
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min_by(F.struct("movie_id", "similarity"), F.struct(distance, F.col("movie_id"))).alias("w"),
        )
        .select("cluster", "members", "w.movie_id", "w.similarity")
    )


def _with_reviews(winners: DataFrame, reviews: DataFrame, order: tuple[str, ...], block_rows: int) -> DataFrame:
    """The model rows of one movie per cluster: its reviews in ``order``, ``block_rows`` to a row.

    The winners' reviews are written once, with a number that tells equal ones apart, and ranked over ranges of
    their order; only the reviews of one block meet.
    """
    token = F.concat_ws("_", "rater_id", "rating")
    own = winners.select("movie_id", F.col("cluster").alias("k"))
    listed = written(
        reviews.where(F.col("rater_id").isNotNull())
        .join(checked_broadcast(own), "movie_id")
        .select("k", *order, token.alias("token"), F.monotonically_increasing_id().alias("row")),
        "model-reviews",
    )
    place = F.col("place") - 1
    blocks = (
        row_rank(listed, "place", ["k"], [*order, "row"])
        .groupBy("k", (place - place % block_rows).cast("int").alias("start"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("tokens"))
        .select("k", "start", F.concat_ws(",", F.col("tokens.token")).alias("reviews"))
    )
    totals = listed.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("total"))
    heads = winners.withColumnRenamed("cluster", "k").join(totals, "k", "left")
    # A movie without reviews is one empty row.
    return blocks.join(checked_broadcast(heads), "k", "right").select(
        "k", "similarity", "movie_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("start", F.lit(0)).alias("start"),
        F.coalesce("reviews", F.lit("")).alias("reviews"), "members",
    )


def kmeans_update(
    assigned: DataFrame, reviews: DataFrame, order: tuple[str, ...] = ("pos",), block_rows: int = MODEL_ROWS
) -> DataFrame:
    """New model: each cluster's winner with its reviews in ``order``."""
    return _with_reviews(written(cluster_winners(assigned), "winners"), reviews, order, block_rows)


def initial_model(
    reviews: DataFrame, movie_ids: list[int], order: tuple[str, ...] = ("pos",), block_rows: int = MODEL_ROWS
) -> DataFrame:
    """A first model from chosen movies."""
    rows = [(k, 0, m, 0.0) for k, m in enumerate(sorted(movie_ids, reverse=True))]
    schema = "cluster int, members bigint, movie_id bigint, similarity float"
    chosen = reviews.sparkSession.createDataFrame(rows, schema)
    found = _with_reviews(chosen, reviews, order, block_rows)
    # A chosen movie that the reviews do not have is no centroid.
    known = reviews.join(F.broadcast(chosen.select("movie_id")), "movie_id", "left_semi").select("movie_id").distinct()
    return found.join(known, "movie_id", "left_semi").select(*[c for c in found.columns if c != "members"])


def kmeans_update_lines(assigned: DataFrame, movies: DataFrame) -> DataFrame:
    """``kmeans_update`` for movies that still have their line, which stays one block."""
    body = F.substr(F.col("line"), F.instr("line", ":") + 1)
    return movies.join(cluster_winners(assigned), "movie_id").select(
        F.col("cluster").alias("k"),
        "similarity",
        "movie_id",
        F.size(F.array_remove(F.split(body, ","), "")).alias("total"),
        F.lit(0).alias("start"),
        body.alias("reviews"),
        "members",
    )


def _centroids_of(winners: DataFrame, reviews: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Flat centroids of the winners, numbered by falling movie_id; the first review of a rater wins."""
    numbered = winners.select("movie_id", (F.row_number().over(Window.orderBy(F.desc("movie_id"))) - 1).alias("k"))
    rated = reviews.where(F.col("rater_id").isNotNull()).join(numbered, "movie_id")
    return rated.groupBy("k", "rater_id").agg(F.min_by("rating", F.struct(*order)).alias("c_rating"))


def kmeans_iterate(
    reviews: DataFrame, model: DataFrame, max_iter: int = 10, order: tuple[str, ...] = ("pos",), block_rows: int = MODEL_ROWS
) -> DataFrame:
    """Assign and update until the centroid movies stay the same or ``max_iter`` passes are done: the model and ``settled``.

    The reviews and each pass's assignment are written to the shared folder; only whether movies of the model
    differ comes back to the driver.  A cluster without members is missing from the next model.
    """
    reviews = written(reviews.select("movie_id", "rater_id", "rating", *[c for c in order if c not in ("movie_id", "rater_id", "rating")]), "reviews")
    centroids, movies, settled = load_centroids(model), model.where("movie_id <> -1").select("movie_id").distinct(), False
    winners = None
    for _ in range(max_iter):
        assigned = written(kmeans_assign(reviews, centroids), "assigned")
        winners = written(cluster_winners(assigned), "winners")
        found = winners.select("movie_id")
        settled = found.join(movies, "movie_id", "left_anti").isEmpty() and movies.join(found, "movie_id", "left_anti").isEmpty()
        if settled:
            break
        centroids, movies = _centroids_of(winners, reviews, order), found
    final = _with_reviews(winners, reviews, order, block_rows).drop("members") if winners is not None else model
    return final.withColumn("settled", F.lit(settled))
