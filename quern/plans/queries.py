"""One query per operator over the table set: (session, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scores as S
from quern.functions.text import tokens
from quern.operators import clustering, jobs, ratings, records, relations, text, traces
from quern.operators.counters import StreamCounters, counted
from quern.plans.views import FIRST_CENTROIDS, table, view
from quern.session import shared_dir
from quern.sources import jobs as job_sources
from quern.sources import sinks
from quern.sources import text as text_sources
from quern.sources.quarantine import Split, split_reviews
from quern.streaming import tasks

Query = Callable[[SparkSession, str], DataFrame]

# Most passes of the k-means query, documents in a block of the inverted list, and sizes of the sort queries.
KMEANS_PASSES = 6
LIST_ROWS = 200
# Reviews in a row of a model; few, so that the centroids of small tables have several rows.
MODEL_ROWS = 10
SORT_PARTS = 16
SPLIT_SAMPLE = 2_000
REVIEW_ORDER = ("rater_id", "rating")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _document_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return text.text_lines(_documents(spark, sf_dir), keep=keep)


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lines(spark, sf_dir, "doc_id").select("doc_id", "line_no", "line")


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_count(_documents(spark, sf_dir))


def sequence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sequence_count(_document_lines(spark, sf_dir, "source"), "source")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.inverted_index(_documents(spark, sf_dir), "doc_id")


def inverted_index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = text.inverted_index_list(_documents(spark, sf_dir), "doc_id", list_rows=LIST_ROWS)
    return lists.select(
        "word", "block", F.col("n_docs").cast("bigint").alias("n_docs"), F.concat_ws(",", F.col("docs").cast("array<string>")).alias("docs")
    )


def term_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_vector(_documents(spark, sf_dir), "source")


def movie_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.reviews_of_lines(view(spark, sf_dir, "movie_lines"))


def parse_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = ratings.reviews_of_lines(view(spark, sf_dir, "movie_lines"), require_underscore=True)
    return reviews.where(F.col("rater_id").isNotNull())


def _split(spark: SparkSession, sf_dir: str) -> Split:
    return split_reviews(view(spark, sf_dir, "mixed_lines"), f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}", require_rater=True)


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed lines and reviews with the reason."""
    return _split(spark, sf_dir).bad


def good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews beside the malformed ones."""
    return _split(spark, sf_dir).good


def edge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sources.edge_source(_document_lines(spark, sf_dir), "line")


def itemset_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sources.itemset_source(_document_lines(spark, sf_dir), "line")


def tera_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = text_sources.tera_source(_document_lines(spark, sf_dir), "line", binary=True)
    return fields.select(F.hex("key").alias("key_hex"), F.octet_length("value").cast("bigint").alias("value_bytes"))


def job_profile_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_sources.job_profiles(view(spark, sf_dir, "profile_lines"))


def result_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_sources.result_lines(view(spark, sf_dir, "result_log_lines"))


def histogram_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.histogram_ratings(view(spark, sf_dir, "ratings"))


def histogram_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.histogram_movies(view(spark, sf_dir, "ratings"))


def histogram_movies_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.histogram_movies_nested(text_sources.movie_source(view(spark, sf_dir, "movie_lines")))


def _first_model(reviews: DataFrame) -> DataFrame:
    return clustering.initial_model(reviews, list(FIRST_CENTROIDS), REVIEW_ORDER, MODEL_ROWS)


def load_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.load_centroids(_first_model(view(spark, sf_dir, "ratings")))


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = clustering.cosine_scores(view(spark, sf_dir, "ratings"), view(spark, sf_dir, "centroids"))
    return scores.withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans_assign(view(spark, sf_dir, "ratings"), view(spark, sf_dir, "centroids"))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.classify(view(spark, sf_dir, "ratings"), view(spark, sf_dir, "centroids"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = clustering.kmeans_update(_assigned(spark, sf_dir), view(spark, sf_dir, "ratings"), REVIEW_ORDER, MODEL_ROWS)
    return updated.withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def kmeans_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = view(spark, sf_dir, "ratings")
    final = clustering.kmeans_iterate(reviews, _first_model(reviews), KMEANS_PASSES, REVIEW_ORDER, MODEL_ROWS)
    return final.withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def kmeans_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating line with the cluster its movie is assigned to."""
    reviews = view(spark, sf_dir, "ratings")
    line = F.format_string("%s:%s_%s", F.col("movie_id").cast("string"), F.col("rater_id").cast("string"), F.col("rating").cast("string"))
    assigned = clustering.kmeans_assign(reviews, view(spark, sf_dir, "centroids"))
    return clustering.kmeans_members(assigned, reviews.select("movie_id", line.alias("line")))


def classify_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification by a model of several lines a centroid that was written as text and read back."""
    reviews = view(spark, sf_dir, "ratings")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    sinks.model_sink(_first_model(reviews), path)
    return clustering.classify(reviews, clustering.load_centroids(text_sources.centroid_source(spark, path)))


def malformed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as lines, and lines without comma: counted by the job that writes, which reads its input once."""
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    seen, lines_read = counted(_document_lines(spark, sf_dir), "lines")
    edges, edges_read = counted(text_sources.edge_source(seen, "line"), "edges")
    sinks.kv_text_sink(edges, path, ("src",), ("dst",))
    return _edge_counts(spark, lines_read.get["lines"], edges_read.get["edges"], spark.read.text(path))


def stream_malformed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream: its progress reports bring the counts of each trigger."""
    rows, progress = _run_folders(spark, "edges")
    raw = spark.readStream.schema(_documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parque[t]")
    edges = text_sources.edge_source(text.text_lines(raw).observe("lines", F.count(F.lit(1)).alias("n")), "line")
    with StreamCounters(spark) as counters:
        writer = edges.observe("edges", F.count(F.lit(1)).alias("n")).writeStream.option("checkpointLocation", progress)
        query = writer.trigger(availableNow=True).start(rows, format="parquet")
        query.awaitTermination()
        found = counters.totals(query)
    return _edge_counts(spark, found["lines"], found["edges"], spark.read.schema("src string, dst string").parquet(rows))


def _edge_counts(spark: SparkSession, lines: int, edges: int, written: DataFrame) -> DataFrame:
    counts = [F.lit(n).cast("bigint").alias(c) for c, n in (("lines", lines), ("edges", edges), ("malformed", lines - edges))]
    return written.agg(F.count(F.lit(1)).alias("written")).select(*counts, "written")


def kv_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating counts written as ``key<TAB>value`` lines and read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    sinks.kv_text_sink(ratings.histogram_ratings(view(spark, sf_dir, "ratings")), path, ("rating",), ("n",))
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].cast("int").alias("rating"), part[1].cast("bigint").alias("n"))


def job_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a log written as tab-separated lines and read back."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    sinks.job_result_sink(job_sources.result_lines(view(spark, sf_dir, "result_log_lines")), path)
    part = F.split("value", "\t")
    numbers = [part[i].cast("double").alias(c) for i, c in enumerate(sinks.RESULT_COLUMNS[:-1])]
    return spark.read.text(path).select(*numbers, part[len(numbers)].alias(sinks.RESULT_COLUMNS[-1]))


def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.self_join(view(spark, sf_dir, "itemsets"))


def adj_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = relations.adj_list(view(spark, sf_dir, "edges"), LIST_ROWS)
    return lists.withColumn("neighbours", F.concat_ws(",", "neighbours"))


def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.row_range(spark, table(spark, sf_dir, "orders").count())


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.teragen(table(spark, sf_dir, "orders"), "o_orderkey")


def teragen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


def terasort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sorted_places(_records(spark, sf_dir))


def sort_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generate, sort, write, read back and validate: rows and errors."""
    path = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    sinks.tera_sink(records.terasort(_records(spark, sf_dir)), path)
    back = text_sources.read_tera(spark, path)
    errors = records.teravalidate(back, order=("block", "pos")).agg(F.count(F.lit(1)).alias("errors"))
    zero = F.lit(0).cast("bigint")
    counts = back.agg(F.count(F.lit(1)).alias("rows")).select("rows", zero.alias("errors"))
    return counts.unionByName(errors.select(zero.alias("rows"), "errors")).agg(*[F.sum(c).alias(c) for c in ("rows", "errors")])


def range_split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.range_split_points(_records(spark, sf_dir), SORT_PARTS, sample_rows=SPLIT_SAMPLE)


def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    points = records.range_split_points(rows, SORT_PARTS, sample_rows=SPLIT_SAMPLE).orderBy("split").collect()
    return records.range_partition(rows, [p["key"] for p in points]).select("key", "part")


def teravalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.teravalidate(view(spark, sf_dir, "sorted_rows"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "job_snapshots")


def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.utility(F.col("join_time"))
    return _snapshots(spark, sf_dir).select("snapshot_id", "job_id", F.round(score, 6).alias("utility"))


def utility_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.utility_readable(F.col("join_time"))
    return _snapshots(spark, sf_dir).select("snapshot_id", "job_id", F.round(score, 6).alias("utility_readable"))


def invert_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = S.invert_utility(F.col("priority") * (F.col("rem_map") - 99.5) / 90)
    return _snapshots(spark, sf_dir).select("snapshot_id", "job_id", F.round(time, 6).alias("time"))


def exec_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.finished_times(view(spark, sf_dir, "job_runs")).select("job_id", "exec_time")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.finished_times(view(spark, sf_dir, "job_runs")).select("job_id", "latency")


def task_time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.task_time_estimate(view(spark, sf_dir, "task_events"), view(spark, sf_dir, "planned_jobs"))


def remaining_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = jobs.remaining_demand(_snapshots(spark, sf_dir))
    return demand.select("snapshot_id", "job_id", F.col("demand").cast("bigint").alias("demand"), "delay")


def horizon_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.horizon_slots(_snapshots(spark, sf_dir))


def backlog_edf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.backlog_edf(_snapshots(spark, sf_dir))


def backlog_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.backlog_fifo(_snapshots(spark, sf_dir))


def risk_reward_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = jobs.risk_reward_rank(_snapshots(spark, sf_dir))
    return ranked.select("snapshot_id", "job_id", "remaining", F.round("reward", 6).alias("reward"))


def backlog_rrh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.backlog_rrh(_snapshots(spark, sf_dir))


def utility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    finish = snapshots.select("snapshot_id", "job_id", (F.col("rem_map") * 10.0).alias("finish"))
    return jobs.utility_summary(snapshots, finish)


def priority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.priority_share(_snapshots(spark, sf_dir)).select("snapshot_id", "job_id", "share")


def equal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.equal_share(_snapshots(spark, sf_dir)).select("snapshot_id", "job_id", "share")


def earliest_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.earliest_deadline(_snapshots(spark, sf_dir))


def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.feasibility(_snapshots(spark, sf_dir))


def concurrency_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.concurrency_timeline(_snapshots(spark, sf_dir), F.col("join_time"), F.col("deadline"))


def _result_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    sinks.result_log_sink(view(spark, sf_dir, "run_logs"), path)
    return job_sources.result_log_source(spark, path)


def result_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per policy and iteration, as the names of their logs say."""
    found = _result_logs(spark, sf_dir).groupBy("policy", "iteration")
    return found.agg(F.count(F.lit(1)).alias("jobs"), F.sum("exec_time").alias("exec_time"))


def result_log_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From logs to jobs online at each second, per policy and iteration: from a job's join time for its execution time."""
    logs = _result_logs(spark, sf_dir)
    return traces.concurrency_timeline(logs, F.col("join_time"), F.col("exec_time"), ("policy", "iteration"))


def gen_job_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = traces.gen_job_profiles(table(spark, sf_dir, "orders"), "o_orderkey")
    return profiles.withColumn("sensitivity", F.round("sensitivity", 6))


def repair_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = traces.repair_sensitivity(_snapshots(spark, sf_dir).withColumn("sensitivity", F.col("sensitivity") - 0.5))
    return repaired.select("snapshot_id", "job_id", F.round("sensitivity", 6).alias("sensitivity"))


def update_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = traces.update_bursts(view(spark, sf_dir, "task_events"), gap_seconds=30)
    return _in_micros(bursts)


def _in_micros(bursts: DataFrame) -> DataFrame:
    """Wall-clock microseconds, which do not depend on the session's time zone."""
    for name in ("burst_start", "burst_end"):
        micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({name} as timestamp_ntz))"
        bursts = bursts.withColumn(name, F.expr(micros))
    return bursts


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream takes no single file; it fits a file and a folder of files alike.
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").isin("view", "click").alias("is_map"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.col("value").alias("run_time"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _run_folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/progress"


def stream_task_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, progress = _run_folders(spark, "estimates")
    # The stream meets the table of planned jobs, so each job has its own class's priors.
    planned = view(spark, sf_dir, "planned_jobs").withColumnRenamed("job_id", "_job")
    events = _event_stream(spark, sf_dir)
    joined = events.join(planned, F.col("job_id") == F.col("_job")).drop("_job")
    tasks.stream_task_totals(joined, rows, progress).awaitTermination()
    return tasks.task_estimates(tasks.total_levels(rows).result(spark))


def stream_update_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, progress = _run_folders(spark, "bursts")
    tasks.stream_update_bursts(_event_stream(spark, sf_dir), rows, progress, keys=("job_id",), gap="1 hour").awaitTermination()
    return _in_micros(tasks.burst_levels(rows, ("job_id",)).result(spark))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        text_source,
        tokenize,
        word_count,
        sequence_count,
        inverted_index,
        inverted_index_list,
        term_vector,
        movie_source,
        parse_reviews,
        bad_rows,
        good_rows,
        edge_source,
        itemset_source,
        tera_source,
        job_profile_source,
        result_log_source,
        histogram_ratings,
        histogram_movies,
        histogram_movies_lines,
        load_centroids,
        cosine_scores,
        classify,
        kmeans_assign,
        kmeans_update,
        kmeans_iterate,
        kmeans_members,
        classify_by_file,
        malformed_edges,
        stream_malformed_edges,
        kv_text_sink,
        job_result_sink,
        self_join,
        adj_list,
        row_range,
        teragen,
        terasort,
        sort_pipeline,
        range_split_points,
        range_partition,
        teravalidate,
        utility,
        utility_readable,
        invert_utility,
        exec_time,
        latency,
        task_time_estimate,
        remaining_demand,
        horizon_slots,
        backlog_edf,
        backlog_fifo,
        risk_reward_rank,
        backlog_rrh,
        utility_summary,
        priority_share,
        equal_share,
        earliest_deadline,
        feasibility,
        concurrency_timeline,
        result_log_files,
        result_log_timeline,
        gen_job_profiles,
        repair_sensitivity,
        update_bursts,
        stream_task_estimate,
        stream_update_bursts,
    )
}
