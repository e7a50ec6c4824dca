"""Counts and indexes over words.

Inputs are frames with one text column; a text may be a line or a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import lines, tokens, trigram
from quern.operators.skew import with_blocks

# Fixed value: words rarer than this in a host are left out of its term vector.
TERM_CUTOFF = 10
# Documents in one row of the inverted list; a word in more documents has several rows.
LIST_ROWS = 100_000


def words(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word, with the ``keep`` columns."""
    return df.select(*keep, text).select(*keep, F.explode(tokens(F.col(text))).alias("word"))


def text_lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line with its 0-based place in the text."""
    return df.select(*keep, lines(F.col(text)).alias("_lines")).select(*keep, F.posexplode("_lines").alias("line_no", "line"))


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """word -> number of occurrences."""
    return words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sequence_count(df: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """(w1, w2, w3, doc) -> occurrences of three neighbouring words inside one line.

    Triples are one string until they are counted.  As most are rare, combining them before the shuffle would keep nearly
    all of a task's in memory or spill them; so they are dealt by triple and doc first, and a hot one costs its task time alone.
    """
    words = df.select(F.col(doc).alias("doc"), tokens(F.col(line)).alias("_words"))
    placed = words.select("doc", "_words", F.posexplode("_words").alias("_place", "_word")).where(F.col("_place") < F.size("_words") - 2)
    triples = placed.select(trigram(F.col("_words"), F.col("_place")).alias("_triple"), "doc")
    counts = triples.repartition("_triple", "doc").groupBy("_triple", "doc").agg(F.count(F.lit(1)).alias("n"))
    part = F.split("_triple", " ")
    return counts.select(*[part[i].alias(f"w{i + 1}") for i in range(3)], "doc", "n")


def inverted_index(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Distinct (word, doc) pairs."""
    once = F.array_distinct(tokens(F.col(text)))
    pairs = df.select(F.col(doc).alias("doc"), once.alias("_words")).select(F.explode("_words").alias("word"), "doc")
    return pairs.distinct()


def inverted_index_list(df: DataFrame, doc: str, text: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """(word, block) -> sorted documents; a word of n documents has ceil(n / list_rows) blocks, numbered from 0.

    No list outgrows a task; together a word's blocks hold every document once.
    """
    pairs = with_blocks(inverted_index(df, doc, text), ["word"], F.col("doc"), list_rows)
    return (
        pairs.groupBy("word", F.col("_block").alias("block"))
        .agg(F.array_sort(F.collect_list("doc")).alias("docs"))
        .select("word", "block", F.size("docs").alias("n_docs"), "docs")
    )


def term_vector(df: DataFrame, host: str, text: str = "text", cutoff: int = TERM_CUTOFF) -> DataFrame:
    """Words of at least ``cutoff`` occurrences per host, sorted by host, most frequent first, then word.

    The sort is a range sort over all three columns, so a host with many words is spread.
    """
    counts = words(df, text, keep=(host,)).groupBy(F.col(host).alias("host"), "word").agg(F.count(F.lit(1)).alias("n"))
    term = F.concat_ws(":", "word", F.col("n").cast("string")).alias("term")
    return counts.where(F.col("n") >= cutoff).orderBy("host", F.desc("n"), "word").select("host", "word", "n", term)
