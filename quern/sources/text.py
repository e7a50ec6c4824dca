"""Line formats: each function takes a frame with a column ``value`` and returns typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.reviews import is_movie_line, movie_id, parse_review, review_tokens
from quern.functions.text import after_last_comma, before_last_comma

# Fixed value: bytes of a sort record's key.
RECORD_KEY_BYTES = 10


def text_source(spark: SparkSession, path: str) -> DataFrame:
    """A row per line with the name of its file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))


def movie_source(lines: DataFrame, value: str = "value", require_underscore: bool = False, permissive: bool = False) -> DataFrame:
    """(movie_id, line, reviews) of each ``movie:rater_rating,...`` line; other lines are dropped.

    ``require_underscore`` leaves out reviews without a rater, as classification wants;
    the histograms count them.
    """
    line = F.col(value)
    parsed = F.transform(review_tokens(line), lambda t: parse_review(t, require_underscore, permissive))
    kept = F.filter(parsed, lambda r: r.isNotNull()) if require_underscore else parsed
    return lines.where(is_movie_line(line)).select(movie_id(line).alias("movie_id"), line.alias("line"), kept.alias("reviews"))


def edge_source(lines: DataFrame, value: str = "value") -> DataFrame:
    """(src, dst) of each ``A1,A2`` line, split at the last comma; a line without comma is malformed and dropped."""
    line = F.col(value)
    return lines.where(F.contains(line, F.lit(","))).select(
        before_last_comma(line).alias("src"), after_last_comma(line).alias("dst")
    )


def itemset_source(lines: DataFrame, value: str = "value") -> DataFrame:
    """(prefix, item) of each ``A1,...,Ak`` line, split at the last comma; other lines are dropped."""
    line = F.col(value)
    return lines.where(F.contains(line, F.lit(","))).select(
        before_last_comma(line).alias("prefix"), after_last_comma(line).alias("item")
    )


def tera_source(lines: DataFrame, value: str = "value", binary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, value): the first ten bytes and the rest; a short line is all key.

    Text columns suit ASCII records.  ``binary`` cuts at bytes for any other text.
    """
    line = F.col(value).cast("binary") if binary else F.col(value)
    rest = F.substr(line, F.lit(RECORD_KEY_BYTES + 1))
    return lines.select(F.substring(line, 1, RECORD_KEY_BYTES).alias("key"), rest.alias("value"), *keep)


def read_tera(spark: SparkSession, path: str) -> DataFrame:
    """Sort records of a folder with their file and place in it (block, pos)."""
    placed = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return tera_source(placed, keep=("file", "block", "pos"))


def centroid_source(spark: SparkSession, path: str) -> DataFrame:
    """Model rows of ``k similarity movie_id total rater_rating,...`` with any white space between.

    A further block of a centroid's reviews is a line of its own with the reviews before it in front of its list:
    ``k similarity movie_id total start rater_rating,...``.  Lines may come in any order, from any number of files.
    """
    part = F.split(F.trim("value"), "\\s+")
    further = F.size(part) > 5
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            part[0].cast("int").alias("k"),
            part[1].cast("float").alias("similarity"),
            part[2].cast("bigint").alias("movie_id"),
            part[3].cast("int").alias("total"),
            F.when(further, part[4].cast("int")).otherwise(0).alias("start"),
            F.coalesce(F.get(part, F.when(further, 5).otherwise(4)), F.lit("")).alias("reviews"),
        )
    )
