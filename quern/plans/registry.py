"""Jobs by name: read text input, run one operator, write its text output.

A job is a plain function from its input frame to its output frame, with the sink's key and
value columns.  ``python -m quern`` runs one from the command line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import clustering, ratings, records, relations, text
from quern.operators.traces import TASK_SECONDS
from quern.sources import text as T
from quern.sources.sinks import kv_text_sink, tera_sink


@dataclass(frozen=True)
class Job:
    """``run(lines, model)``: lines has value and file_name; model is None unless the job needs one."""

    run: Callable[[DataFrame, DataFrame | None], DataFrame]
    key: tuple[str, ...]
    value: tuple[str, ...]
    needs_model: bool = False
    separator: str = "|"


def _movies(lines: DataFrame) -> DataFrame:
    return T.movie_source(lines, require_underscore=True)


def _classify(lines: DataFrame, model: DataFrame) -> DataFrame:
    return clustering.classify(ratings.flatten_reviews(_movies(lines)), clustering.load_centroids(model))


def _kmeans(lines: DataFrame, model: DataFrame) -> DataFrame:
    movies = _movies(lines)
    assigned = clustering.kmeans_assign(ratings.flatten_reviews(movies), clustering.load_centroids(model))
    model = clustering.kmeans_update_lines(assigned, movies)
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("similarity", "movie_id", "total", "reviews")])
    members = clustering.kmeans_members(assigned, movies).select(F.col("cluster").alias("k"), "line")
    return model.select("k", row.alias("line")).unionByName(members)


JOBS: dict[str, Job] = {
    "WordCount": Job(lambda lines, _: text.word_count(lines, "value"), ("word",), ("n",)),
    "SequenceCount": Job(
        lambda lines, _: text.sequence_count(lines, "file_name", "value"), ("w1", "w2", "w3", "doc"), ("n",)
    ),
    "InvertedIndex": Job(lambda lines, _: text.inverted_index(lines, "file_name", "value"), ("word",), ("doc",)),
    "TermVectorPerHost": Job(lambda lines, _: text.term_vector(lines, "file_name", "value"), ("host",), ("term",)),
    "HistogramRatings": Job(
        lambda lines, _: ratings.histogram_ratings(ratings.reviews_of_lines(lines)), ("rating",), ("n",)
    ),
    "HistogramMovies": Job(lambda lines, _: ratings.histogram_movies_nested(T.movie_source(lines)), ("bin",), ("n",)),
    "Classification": Job(_classify, ("cluster",), ("movie_id",), needs_model=True),
    "Kmeans": Job(_kmeans, ("k",), ("line",), needs_model=True),
    "SelfJoin": Job(
        lambda lines, _: relations.self_join(T.itemset_source(lines)), ("prefix", "item_a"), ("item_b",), separator=","
    ),
    "AdjList": Job(
        lambda lines, _: relations.packed_adjacency(relations.adj_list(T.edge_source(lines))), ("node",), ("adjacency",)
    ),
}


def task_seconds(name: str) -> tuple[int, int]:
    """Map and reduce seconds per task a job is planned with."""
    return TASK_SECONDS[name]


def run_job(spark: SparkSession, name: str, source: str, target: str, model: str | None = None) -> None:
    """Run a text job from a folder of lines to a folder of ``key<TAB>value`` lines."""
    job = JOBS[name]
    if job.needs_model and model is None:
        raise ValueError(f"{name} needs a model file")
    lines = T.text_source(spark, source)
    kv_text_sink(job.run(lines, T.centroid_source(spark, model) if model else None), target, job.key, job.value, job.separator)


def run_generate(spark: SparkSession, rows: int, target: str, parts: int | None = None) -> None:
    tera_sink(records.teragen(records.row_range(spark, rows, parts)), target)


def run_sort(spark: SparkSession, source: str, target: str, parts: int) -> None:
    tera_sink(records.terasort(T.read_tera(spark, source), parts), target)


def run_validate(spark: SparkSession, source: str, target: str) -> None:
    report = records.teravalidate(T.read_tera(spark, source), order=("block", "pos"))
    report.write.mode("overwrite").text(target)
