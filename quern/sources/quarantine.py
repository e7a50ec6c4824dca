"""Rating lines split in one pass: reviews to work on, and what is malformed, with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.reviews import line_fault, movie_id, review_fault, review_tokens


@dataclass(frozen=True)
class Split:
    """``good``: (movie_id, pos, rater_id, rating); ``bad``: (movie, pos, token, reason).

    A line that is bad as a whole is one bad row without movie and place, its text the token.
    """

    good: DataFrame
    bad: DataFrame


def split_reviews(lines: DataFrame, path: str, value: str = "value", require_rater: bool = False) -> Split:
    """Write the tokens of ``movie:rater_rating,...`` lines to ``path``, good and bad ones in folders of their own, and read both.

    The lines are read once, by the one job that writes.  No token is lost: each is in one of both.  A movie without tokens gives
    no row.  ``require_rater`` takes a token without rater, or whose rater is no number, for bad; else the rater of such a
    token is null.  Null lines are bad lines with a null token.
    """
    line = F.coalesce(F.col(value), F.lit(""))
    faulty = line_fault(line)
    whole = F.struct(F.lit(None).cast("int").alias("pos"), F.col(value).alias("token"), F.col("line_reason").alias("reason"))
    each = F.transform(
        review_tokens(line),
        lambda token, i: F.struct(i.alias("pos"), token.alias("token"), review_fault(token, require_rater).alias("reason")),
    )
    rows = (
        lines.select(F.col(value), faulty.alias("line_reason"))
        .select(
            F.when(F.col("line_reason").isNull(), F.substring_index(line, ":", 1)).alias("movie"),
            F.inline(F.when(F.col("line_reason").isNotNull(), F.array(whole)).otherwise(each)),
        )
        .withColumn("good", F.col("reason").isNull())
    )
    rows.write.partitionBy("good").parquet(path)
    written = lines.sparkSession.read.schema("movie string, pos int, token string, reason string, good boolean").parquet(path)
    at = F.instr("token", "_")
    rater = F.when(at > 0, F.substr("token", F.lit(1), at - 1).try_cast("int"))
    good = written.where("good").select(
        movie_id(F.concat("movie", F.lit(":"))).alias("movie_id"), "pos", rater.alias("rater_id"),
        F.substr("token", at + 1).cast("int").alias("rating"),
    )
    return Split(good, written.where("not good").select("movie", "pos", "token", "reason"))
