"""Rating lines ``movie:rater_rating,rater_rating,...`` as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def movie_id(line: Column) -> Column:
    """Text before the first colon as a number; the caller keeps lines with a colon past the start."""
    return F.substring_index(line, ":", 1).cast("bigint")


def is_movie_line(line: Column) -> Column:
    return F.instr(line, ":") > 1


def review_tokens(line: Column) -> Column:
    """Non-empty ``rater_rating`` tokens after the first colon."""
    body = F.substr(line, F.instr(line, ":") + 1)
    return F.array_remove(F.split(body, ","), "")


def parse_review(token: Column, require_underscore: bool = False, permissive: bool = False) -> Column:
    """Struct (rater_id, rating) of one token; null if an underscore is required and absent.

    Without an underscore the whole token is the rating and there is no rater.  A part that
    is no number fails the query, or gives a null in permissive mode.
    """
    at = F.instr(token, "_")
    rater_text = F.when(at > 0, F.substr(token, F.lit(1), at - 1))
    rating_text = F.substr(token, at + 1)
    if permissive:
        rater, rating = rater_text.try_cast("int"), rating_text.try_cast("int")
    else:
        rater, rating = rater_text.cast("int"), rating_text.cast("int")
    review = F.struct(rater.alias("rater_id"), rating.alias("rating"))
    return F.when(at > 0, review) if require_underscore else review


_NUMBER = r"^[+-]?[0-9]+$"


def _is_number(text: Column, kind: str) -> Column:
    """Whether a text is a whole number of the kind, without white space or fraction."""
    return text.rlike(_NUMBER) & text.try_cast(kind).isNotNull()


def line_fault(line: Column) -> Column:
    """Why a whole line gives no reviews, else null."""
    return F.when(~is_movie_line(line), "no movie").when(~_is_number(F.substring_index(line, ":", 1), "bigint"), "movie is no number")


def review_fault(token: Column, require_rater: bool = False) -> Column:
    """Why a token is no review, else null; the rater counts only where it is required."""
    at = F.instr(token, "_")
    rater = F.when(at == 0, "no rater").when(~_is_number(F.substr(token, F.lit(1), at - 1), "int"), "rater is no number")
    rating = F.when(~_is_number(F.substr(token, at + 1), "int"), "rating is no number")
    return F.coalesce(rater, rating) if require_rater else rating
