"""Task events as a stream: running estimates per job and bursts of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.jobs import STEP, estimate
from quern.operators.traces import merge_bursts
from quern.streaming.levels import FANOUT, Levels

# Fixed value: changes are gathered until none came for this long.
QUIET_GAP = "1 second"
# A job without events for this long has ended.
IDLE = "1 day"


def stream_task_estimate(events: DataFrame, map_prior: Column, red_prior: Column, step: int = STEP) -> DataFrame:
    """Estimate per job and phase over the events so far; for batch and streaming frames alike.

    Priors are literals, or aggregates of columns that the events carry for their job.  In update mode each
    trigger gives the estimates that changed.
    """
    done = F.when(F.col("succeeded"), F.col("run_time").cast("decimal(18,6)"))
    totals = events.groupBy("job_id", "is_map").agg(
        F.coalesce(F.sum(done), F.lit(0)).alias("run_time"), F.count(done).alias("tasks"),
        map_prior.alias("_map"), red_prior.alias("_red"),
    )
    prior = F.when(F.col("is_map"), F.col("_map")).otherwise(F.col("_red"))
    return totals.select("job_id", "is_map", "tasks", estimate(F.col("run_time"), F.col("tasks"), prior, step).alias("estimate"))


def partial_bursts(events: DataFrame, keys: tuple[str, ...] = (), gap: str = QUIET_GAP) -> DataFrame:
    """(keys, burst_start, burst_end, changes) of the events at hand; ``burst_levels`` joins those of several batches."""
    bursts = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return bursts.select(*keys, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "changes")


def burst_levels(path: str, keys: tuple[str, ...] = (), fanout: int = FANOUT) -> Levels:
    """Where a stream keeps its partial bursts; ``result`` gives the bursts of all events, those still open at the end too."""
    return Levels(path, lambda parts: merge_bursts(parts, keys), fanout)


def stream_update_bursts(
    events: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = (), gap: str = QUIET_GAP, fanout: int = FANOUT
) -> StreamingQuery:
    """Keep the partial bursts of each trigger below ``path``, working through what has arrived.

    Nothing is held between triggers and no event is too late: however the events lie in files,
    merging the parts gives the same bursts.  Reading them does not grow with the triggers, but with their logarithm.
    """
    levels = burst_levels(path, keys, fanout)
    writer = events.writeStream.foreachBatch(lambda batch, number: levels.add(partial_bursts(batch, keys, gap), number))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_totals(events: DataFrame) -> DataFrame:
    """(job_id, is_map, run_time, tasks, map_prior, red_prior, last) of the events at hand, which add up in any order."""
    done = F.when(F.col("succeeded"), F.col("run_time").cast("decimal(18,6)"))
    return events.groupBy("job_id", "is_map").agg(
        F.coalesce(F.sum(done), F.lit(0)).cast("decimal(38,6)").alias("run_time"), F.count(done).alias("tasks"),
        F.max("map_prior").alias("map_prior"), F.max("red_prior").alias("red_prior"), F.max("ts").alias("last"),
    )


def merge_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("job_id", "is_map").agg(
        F.sum("run_time").cast("decimal(38,6)").alias("run_time"), F.sum("tasks").alias("tasks"),
        F.max("map_prior").alias("map_prior"), F.max("red_prior").alias("red_prior"), F.max("last").alias("last"),
    )


def total_levels(path: str, idle: str = IDLE, fanout: int = FANOUT) -> Levels:
    """Where a stream keeps its totals per job and phase.

    A job whose last event is more than ``idle`` before the newest of the parts that are merged has ended: its totals leave the open parts.
    Should it come back, both are added up when the estimates are read.
    """

    def ended(merged: DataFrame) -> Column:
        newest = merged.agg(F.max("last")).first()[0]
        return F.coalesce(F.col("last") < F.lit(newest) - F.expr(f"interval {idle}"), F.lit(False))

    return Levels(path, merge_totals, fanout, ended)


def stream_task_totals(events: DataFrame, path: str, checkpoint: str, idle: str = IDLE, fanout: int = FANOUT) -> StreamingQuery:
    """Keep the totals of each trigger below ``path``, for events with the priors of their job (map_prior, red_prior).

    Spark holds no state for it; what is merged at each level are the jobs still at work, and ``task_estimates`` reads
    the estimates of all jobs at any time.
    """
    levels = total_levels(path, idle, fanout)
    writer = events.writeStream.foreachBatch(lambda batch, number: levels.add(partial_totals(batch), number))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_estimates(totals: DataFrame, step: int = STEP) -> DataFrame:
    """(job_id, is_map, tasks, estimate) of totals."""
    prior = F.when(F.col("is_map"), F.col("map_prior")).otherwise(F.col("red_prior"))
    return totals.select("job_id", "is_map", "tasks", estimate(F.col("run_time"), F.col("tasks"), prior, step).alias("estimate"))


def update_into(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each trigger to ``path/batch=N``.

    A trigger that runs again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = result.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, keys: tuple[str, ...] = ("job_id", "is_map")) -> DataFrame:
    """The last update of each key among folders ``batch=N``."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return updates.groupBy(*keys).agg(newest).select(*keys, *[f"v.{c}" for c in values])
