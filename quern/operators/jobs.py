"""Scores, backlogs and shares over tables of job snapshots.

A snapshot frame has one row per job: the ``partition`` columns that name the snapshot, job_id,
rem_map, rem_red (tasks left), est_map, est_red (seconds per task), deadline, join_time,
priority, deadline_type, utility_type, sensitivity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scores as S
from quern.functions.numeric import exact_sum, round2
from quern.operators.ordering import running_total
from quern.operators.skew import join_totals

SNAPSHOT = ("snapshot_id",)
# Slot length in seconds, slots of the cluster, and the two rates of the reward.
STEP = 10
CAPACITY = 40
REWARD_ALPHA = 0.3
DISCOUNT_RATE = 9.0
# Rewards closer than this many places count as equal, so that summing order never decides a rank.
REWARD_PLACES = 9


def with_utilities(jobs: DataFrame, finish: Column) -> DataFrame:
    """Add both utilities for a finishing time."""
    return jobs.withColumn("utility", S.utility(finish)).withColumn("utility_readable", S.utility_readable(finish))


def finished_times(runs: DataFrame) -> DataFrame:
    """Add exec_time and latency to rows of launch_ms, finish_ms (null while running), deadline."""
    launch, finish = F.col("launch_ms"), F.col("finish_ms")
    return runs.withColumn("exec_time", S.exec_time(launch, finish)).withColumn(
        "latency", S.latency(launch, finish, F.col("deadline"))
    )


def remaining_demand(jobs: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Add the slots still needed and the seconds the cluster takes for them."""
    return jobs.withColumn("demand", S.task_demand(step)).withColumn(
        "delay", S.demand_delay(F.col("demand"), capacity, step)
    )


def horizon_slots(
    jobs: DataFrame, map_slots: int = CAPACITY, red_slots: int = CAPACITY, step: int = STEP, partition: tuple[str, ...] = SNAPSHOT
) -> DataFrame:
    """Slot lengths the requested tasks of a snapshot fill."""
    map_demand = F.sum(F.col("rem_map") * F.floor(F.col("est_map") / step)) / float(map_slots)
    red_demand = F.sum(F.col("rem_red") * F.floor(F.col("est_red") / step)) / float(red_slots)
    return jobs.groupBy(*partition).agg(F.ceil(map_demand + red_demand).cast("bigint").alias("slots"))


def backlog(
    jobs: DataFrame,
    rank: Column,
    capacity: int = CAPACITY,
    step: int = STEP,
    partition: tuple[str, ...] = SNAPSHOT,
    ranges: int | None = None,
) -> DataFrame:
    """Each job's finishing time and utilities when the jobs of a snapshot run one after another.

    Lower ranks run first, equal ranks by job_id.
    """
    ranked = remaining_demand(jobs, capacity, step).withColumn("rank", rank)
    run = running_total(ranked, F.col("delay"), "finish", list(partition), ["rank", "job_id"], ranges)
    return with_utilities(run, F.col("finish"))


def summarise_utilities(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Least and total of both utilities per snapshot; the totals are exact and so the same for rows in any order."""
    found = jobs.groupBy(*partition).agg(
        F.min("utility").alias("min_utility"),
        exact_sum(F.col("utility")).alias("total_utility"),
        F.min("utility_readable").alias("min_readable"),
        exact_sum(F.col("utility_readable")).alias("total_readable"),
    )
    return found.select(*partition, *[round2(F.col(c)).alias(c) for c in found.columns if c not in partition])


def backlog_edf(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT, **options) -> DataFrame:
    """Utilities when the earliest current deadline runs first."""
    return summarise_utilities(backlog(jobs, F.col("deadline"), partition=partition, **options), partition)


def backlog_fifo(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT, **options) -> DataFrame:
    """Utilities when the earliest join time runs first."""
    return summarise_utilities(backlog(jobs, F.col("join_time"), partition=partition, **options), partition)


def risk_reward_rank(
    jobs: DataFrame, capacity: int = CAPACITY, partition: tuple[str, ...] = SNAPSHOT, readable: bool = True
) -> DataFrame:
    """Add the reward of running a job now: discounted yield against the decay of all other jobs.

    The others' decay is the snapshot's total less the job's own, so no job meets another.
    The total is taken over decimals and does not depend on the order of the rows.
    """
    linear = F.col("utility_type") == S.LINEAR
    decay = F.when(linear, F.col("sensitivity")).otherwise(-F.col("priority") * F.col("sensitivity") / 4)
    remaining = F.col("est_map") * F.ceil(F.col("rem_map") / float(capacity)) + F.col("est_red") * F.ceil(
        F.col("rem_red") / float(capacity)
    )
    now = F.lit(0.0)
    expire = F.when(linear, float("inf")).otherwise(S.invert_utility(now))
    prepared = (
        jobs.withColumn("_decay", decay.cast("decimal(38,12)"))
        .withColumn("remaining", remaining.cast("double"))
        .withColumn("_expire", expire)
        .withColumn("_yield", S.utility_readable(now) if readable else S.utility(now))
    )
    joined = join_totals(prepared, list(partition), F.sum("_decay").alias("_total"))
    others = F.col("_total").cast("double") - F.col("_decay").cast("double")
    present = F.col("_yield") / (1 + DISCOUNT_RATE * F.col("remaining"))
    gain = REWARD_ALPHA * present + (1 - REWARD_ALPHA) * others * F.least("remaining", "_expire")
    at_zero = F.when(gain > 0, float("inf")).when(gain < 0, float("-inf")).otherwise(float("nan"))
    reward = F.when(F.col("remaining") == 0, at_zero).otherwise(F.try_divide(gain, F.col("remaining")))
    return joined.withColumn("reward", reward).drop("_decay", "_total", "_expire", "_yield")


def backlog_rrh(
    jobs: DataFrame,
    capacity: int = CAPACITY,
    step: int = STEP,
    partition: tuple[str, ...] = SNAPSHOT,
    descending: bool = False,
    readable: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Utilities when jobs run in order of their reward, the lowest first unless ``descending``."""
    rewarded = risk_reward_rank(jobs, capacity, partition, readable)
    rank = F.round("reward", REWARD_PLACES)
    run = backlog(rewarded, -rank if descending else rank, capacity, step, partition, ranges)
    return summarise_utilities(run, partition)


def utility_summary(jobs: DataFrame, finish: DataFrame, partition: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Utilities per snapshot given a finishing time per job: rows (partition, job_id, finish)."""
    joined = jobs.join(finish, [*partition, "job_id"])
    return summarise_utilities(with_utilities(joined, F.col("finish")), partition)


def priority_share(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Add each job's share of 100: 5, and the rest by priority in whole parts; only the 5 if no job has priority."""
    counts = (F.count(F.lit(1)).alias("_n"), F.sum("priority").alias("_sum"))
    part = F.coalesce(F.try_divide((100.0 - 5 * F.col("_n")) * F.col("priority"), F.col("_sum")), F.lit(0.0))
    return join_totals(jobs, list(partition), *counts).withColumn("share", 5 + part.cast("bigint")).drop("_n", "_sum")


def equal_share(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Add 100 over the number of jobs, in hundredths, less one hundredth if the sum would pass 100.

    Rounding adds less than one hundredth per job, so taking one from each is always enough.
    """
    counted = join_totals(jobs, list(partition), F.count(F.lit(1)).alias("_n"))
    cents = F.bround(round2(100.0 / F.col("_n")) * 100).cast("bigint")
    over = cents * F.col("_n") > 100 * 100
    share = (cents - F.when(over & (cents > 0), 1).otherwise(0)) / 100.0
    return counted.withColumn("share", share).drop("_n")


def earliest_deadline(jobs: DataFrame, partition: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Per snapshot the job with the earliest deadline counted from its join time."""
    due = F.col("deadline") + F.col("join_time")
    first = F.min(F.struct(due.alias("due"), F.col("job_id"))).alias("first")
    return jobs.groupBy(*partition).agg(first).select(*partition, "first.job_id", "first.due")


def feasibility(
    jobs: DataFrame,
    map_tasks: int = 100,
    map_time: int = 180,
    slots: int = CAPACITY,
    partition: tuple[str, ...] = SNAPSHOT,
    ranges: int | None = None,
) -> DataFrame:
    """Per snapshot the jobs whose deadline comes before all work due by then can be done.

    Only the deadline matters, so jobs are counted per deadline before anything is put in order.
    """
    per_deadline = jobs.groupBy(*partition, "deadline").agg(F.count(F.lit(1)).alias("n"))
    due = running_total(per_deadline, F.col("n"), "due", list(partition), ["deadline"], ranges)
    room = (F.col("deadline") / float(map_time)).cast("bigint") * slots
    late = F.when(F.col("due") * map_tasks > room, F.col("n")).otherwise(0)
    return due.groupBy(*partition).agg(F.sum(late).alias("infeasible"))


def phase_totals(events: DataFrame) -> DataFrame:
    """Successful tasks and their run time per job and phase.

    Run times are added as decimals: their whole seconds are wanted, and a sum of doubles could
    fall on either side of one.
    """
    done = F.when(F.col("succeeded"), F.col("run_time").cast("decimal(18,6)"))
    return events.groupBy("job_id", "is_map").agg(
        F.coalesce(F.sum(done), F.lit(0)).alias("run_time"), F.count(done).alias("tasks")
    )


def estimate(run_time: Column, tasks: Column, prior: Column, step: int = STEP) -> Column:
    """Mean task time in whole seconds with the prior as one more task, rounded up past a step."""
    whole = (run_time + prior).cast("bigint")
    return S.round_up(F.floor(whole / (tasks + 1)), step)


def task_time_estimate(events: DataFrame, jobs: DataFrame, step: int = STEP) -> DataFrame:
    """Seconds per map and reduce task of each job, from its prior and its finished tasks.

    ``jobs`` has job_id, map_prior, red_prior; a job without events keeps its prior.
    """
    phases = F.explode(
        F.array(
            F.struct(F.lit(True).alias("is_map"), F.col("map_prior").alias("prior")),
            F.struct(F.lit(False).alias("is_map"), F.col("red_prior").alias("prior")),
        )
    )
    wanted = jobs.select("job_id", phases.alias("p")).select("job_id", "p.is_map", "p.prior")
    joined = wanted.join(phase_totals(events), ["job_id", "is_map"], "left")
    run_time, tasks = F.coalesce("run_time", F.lit(0)), F.coalesce("tasks", F.lit(0))
    return joined.select(
        "job_id", "is_map", tasks.cast("bigint").alias("tasks"), estimate(run_time, tasks, F.col("prior"), step).alias("estimate")
    )
