"""Histograms over movie ratings.

Flat frames have one row per review (movie_id, rater_id, rating); a movie without reviews is
one row with nulls.  Nested frames have one row per movie and an array ``reviews``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.reviews import is_movie_line, movie_id, parse_review, review_tokens

# Fixed value: width of a bin of average ratings.
BIN_WIDTH = 0.5


def flatten_reviews(movies: DataFrame, keep: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """One row per review with its place; a movie without reviews keeps one row with nulls."""
    flat = movies.select(*keep, F.posexplode_outer("reviews").alias("pos", "review"))
    return flat.select(*keep, "pos", "review.rater_id", "review.rating")


def reviews_of_lines(lines: DataFrame, value: str = "value", require_underscore: bool = False, permissive: bool = False) -> DataFrame:
    """Flat reviews straight from ``movie:rater_rating,...`` lines, without an array of structs between.

    A token left out for want of an underscore stays as a row of nulls, as does a movie without tokens.
    """
    line = F.col(value)
    tokens = lines.select(value).where(is_movie_line(line)).select(
        movie_id(line).alias("movie_id"), F.posexplode_outer(review_tokens(line)).alias("pos", "token")
    )
    review = parse_review(F.col("token"), require_underscore, permissive)
    return tokens.select("movie_id", "pos", review.alias("review")).select("movie_id", "pos", "review.rater_id", "review.rating")


def histogram_ratings(reviews: DataFrame) -> DataFrame:
    """rating -> number of reviews."""
    rated = reviews.where(F.col("rating").isNotNull())
    return rated.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def average_bin(total: Column, count: Column) -> Column:
    """Upper edge of the half-open bin that holds the average; 0.0 for a movie without reviews.

    The average is single precision, as an average just below an edge may round onto it.
    """
    average = F.try_divide(total, count).cast("float").cast("double")
    return F.when(count == 0, 0.0).otherwise(F.floor(average / BIN_WIDTH) * BIN_WIDTH + BIN_WIDTH)


def _bins(per_movie: DataFrame) -> DataFrame:
    binned = per_movie.select(average_bin(F.col("total"), F.col("count")).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_movies(reviews: DataFrame, key: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """bin of the average rating -> number of movies, from flat reviews."""
    totals = (F.coalesce(F.sum("rating"), F.lit(0)).alias("total"), F.count("rating").alias("count"))
    return _bins(reviews.groupBy(*key).agg(*totals))


def histogram_movies_nested(movies: DataFrame) -> DataFrame:
    """The same from one row per movie: the averages need no shuffle."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate("reviews", zero, lambda acc, r: acc + r["rating"])
    return _bins(movies.select(total.alias("total"), F.size("reviews").alias("count")))
