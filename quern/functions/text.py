"""Text columns: tokens, lines, trigrams and last-comma splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of words beside the space, and those of lines beside the line feed.  They are replaced by
# these, as a split at one plain character takes no regular expression.
WORD_BREAKS = ("\t", "\n", "\r", "\f")
LINE_BREAKS = ("\r\n", "\r")


def _replaced(text: Column, breaks: tuple[str, ...], by: str) -> Column:
    for found in breaks:
        text = F.replace(text, F.lit(found), F.lit(by))
    return text


def tokens(text: Column) -> Column:
    """Array of words; case and punctuation are kept and no word is empty."""
    return F.array_remove(F.split(_replaced(text, WORD_BREAKS, " "), " "), "")


def lines(text: Column) -> Column:
    """Array of lines as a line reader yields them.

    A final line break ends the last line instead of starting an empty one, and an
    empty text has no lines.
    """
    parts = F.split(_replaced(text, LINE_BREAKS, "\n"), "\n")
    last = F.size(parts) - 1
    ended = F.when(F.get(parts, last) == "", F.slice(parts, 1, last)).otherwise(parts)
    return F.when(text != "", ended).otherwise(F.array().cast("array<string>"))


def trigram(words: Column, place: Column) -> Column:
    """The three neighbouring words from a place on with one space between, which no word has; the place must have them."""
    return F.concat_ws(" ", *[F.get(words, place + i) for i in range(3)])


def before_last_comma(line: Column) -> Column:
    """Everything before the last comma; null for a line without one."""
    return F.when(F.contains(line, F.lit(",")), F.regexp_extract(line, "(?s)^(.*),[^,]*$", 1))


def after_last_comma(line: Column) -> Column:
    """Everything after the last comma; null for a line without one."""
    return F.when(F.contains(line, F.lit(",")), F.substring_index(line, ",", -1))
