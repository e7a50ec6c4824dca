"""Synthetic job traces and the number of jobs online over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores as S
from quern.functions.numeric import exponential, gaussian, round2, uniform
from quern.operators.ordering import in_order, running_total
from quern.sources.jobs import PROFILE_FIELDS

# Map and reduce seconds per task that each class of job is planned with.
TASK_SECONDS = {
    "Classification": (30, 120),
    "HistogramMovies": (15, 95),
    "HistogramRatings": (25, 105),
    "InvertedIndex": (40, 120),
    "SelfJoin": (20, 70),
    "SequenceCount": (50, 70),
    "WordCount": (40, 80),
    "TeraGen": (10, 130),
    "AdjList": (200, 200),
    "Kmeans": (20, 20),
    "TermVectorPerHost": (155, 1200),
}
# The classes a trace draws from, and its defaults.
TRACE_CLASSES = (
    "Classification",
    "HistogramMovies",
    "HistogramRatings",
    "InvertedIndex",
    "SelfJoin",
    "SequenceCount",
    "WordCount",
    "TeraGen",
)
FIRST_ARRIVAL = 5.0
MEAN_GAP = 130.0
MAP_TASKS, RED_TASKS, SLOTS = 100, 20, 40
HARD_SHARE, SOFT_SHARE = 0.2, 0.6
PRIORITIES = 5
GAMMA_HARD, GAMMA_SOFT, GAMMA_NONE = 5.0, 0.04, 0.0
DEVIATION_HARD, DEVIATION_SOFT = 0.5, 0.005
NOT_SET = -1000.0

TICKS_PER_CHUNK = 86_400


def _not_negative(key: Column, draw: str, mean: float, deviation: float, seed: int) -> Column:
    """A normal draw, made again while negative; three draws leave less than one in 10^40 to ``abs``."""
    tries = [gaussian(key, f"{draw}{i}", mean, deviation, seed) for i in range(3)]
    kept = [F.when(t >= 0, t) for t in tries[:-1]]
    return F.coalesce(*kept, F.abs(tries[-1]))


def repaired_sensitivity(job: Column, seed: int = 0) -> Column:
    """The sensitivity if it suits the deadline type and kind of utility, else a new draw."""
    beta, kind = F.col("sensitivity"), F.col("deadline_type")
    hard_line = F.when((beta > -1) & (beta <= -0.7), beta).otherwise(-(0.7 + 0.3 * uniform(job, "hard", seed)))
    soft_line = F.when((beta >= -0.3) & (beta < -0.1), beta).otherwise(-(0.1 + 0.3 * uniform(job, "soft", seed)))
    hard = F.when(beta >= GAMMA_HARD / 2, beta).otherwise(
        _not_negative(job, "hard", GAMMA_HARD, DEVIATION_HARD, seed)
    )
    soft = F.when((beta > 0) & (beta <= 1), beta).otherwise(
        _not_negative(job, "soft", GAMMA_SOFT, DEVIATION_SOFT, seed)
    )
    linear = F.when(kind == S.HARD, hard_line).when(kind == S.SOFT, soft_line).otherwise(0.0)
    sigmoid = F.when(kind == S.HARD, hard).when(kind == S.SOFT, soft).otherwise(GAMMA_NONE)
    return F.when(F.col("utility_type") == S.LINEAR, linear).otherwise(sigmoid)


def repair_sensitivity(jobs: DataFrame, job: str = "job_id", seed: int = 0) -> DataFrame:
    return jobs.withColumn("sensitivity", repaired_sensitivity(F.col(job), seed))


def _class_value(choice: Column, values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])[choice]


def gen_job_profiles(
    jobs: DataFrame,
    job: str = "job_id",
    seed: int = 0,
    mean_gap: float = MEAN_GAP,
    utility_type: int = S.SIGMOID,
    ranges: int | None = None,
) -> DataFrame:
    """A synthetic profile for every job id.

    Jobs arrive in order of their id, the first two at once and the others after exponential gaps
    in hundredths of a second, so arrivals add up exactly.  All draws are fixed by seed and id.
    """
    ids = jobs.select(F.col(job).alias("job_id"))
    first_two = [r["job_id"] for r in ids.orderBy("job_id").limit(2).collect()]
    key = F.col("job_id")
    gap = F.bround(exponential(key, "gap", mean_gap, seed) * 100).cast("bigint")
    counted = F.when(key.isin(first_two), 0).otherwise(gap)
    choice = F.floor(uniform(key, "class", seed) * len(TRACE_CLASSES)).cast("int")
    map_time = _class_value(F.col("_class"), [TASK_SECONDS[c][0] for c in TRACE_CLASSES])
    red_time = _class_value(F.col("_class"), [TASK_SECONDS[c][1] for c in TRACE_CLASSES])
    run_time = MAP_TASKS / SLOTS * map_time + RED_TASKS / SLOTS * red_time
    kind = uniform(key, "type", seed)
    drawn = (
        ids.withColumn("_gap", counted)
        .withColumn("_class", choice)
        .withColumn(
            "deadline_type",
            F.when(kind < HARD_SHARE, S.HARD).when(kind < HARD_SHARE + SOFT_SHARE, S.SOFT).otherwise(S.NO_DEADLINE),
        )
        .withColumn("utility_type", F.lit(utility_type))
        .withColumn("sensitivity", F.lit(NOT_SET))
        .select(
            "job_id",
            F.lit(MAP_TASKS).alias("map_tasks"),
            F.lit(RED_TASKS).alias("red_tasks"),
            F.ceil((1 + uniform(key, "deadline", seed)) * run_time).cast("double").alias("deadline"),
            "_gap",
            F.floor(uniform(key, "priority", seed) * PRIORITIES + 1).cast("double").alias("priority"),
            "deadline_type",
            "utility_type",
            repaired_sensitivity(key, seed).alias("sensitivity"),
            _class_value(F.col("_class"), list(TRACE_CLASSES)).alias("job_class"),
            F.concat(F.lit("job"), key.cast("string")).alias("job_name"),
        )
    )
    arrived = running_total(drawn, F.col("_gap"), "_cents", [], ["job_id"], ranges)
    join_time = FIRST_ARRIVAL + F.col("_cents") / 100.0
    return arrived.select("job_id", *[join_time.alias(c) if c == "join_time" else c for c, _ in PROFILE_FIELDS])


def concurrency_timeline(
    jobs: DataFrame, start: Column, duration: Column, partition: tuple[str, ...] = ()
) -> DataFrame:
    """(tick, online): jobs online at each whole second, from 1 to the tick of the last end.

    A job counts from the first tick after its start and no more from the first after its end.
    Ticks are worked on a day at a time; one row per day carries the count over.
    """
    keys = list(partition)
    moments = jobs.select(*keys, (F.floor(start) + 1).alias("_from"), (F.floor(start + duration) + 1).alias("_to"))
    changes = F.explode(
        F.array(
            F.struct(F.col("_from").alias("tick"), F.lit(1).alias("change")),
            F.struct(F.col("_to").alias("tick"), F.lit(-1).alias("change")),
        )
    )
    day = F.floor(F.col("tick") / TICKS_PER_CHUNK)
    per_tick = (
        moments.select(*keys, changes.alias("c"))
        .groupBy(*keys, F.col("c.tick").alias("tick"))
        .agg(F.sum("c.change").alias("change"))
    )
    last = moments.groupBy(*keys).agg(F.max("_to").alias("_last"))
    first_tick = F.greatest(F.lit(1), F.col("_day") * TICKS_PER_CHUNK)
    last_tick = F.least(F.col("_last"), F.col("_day") * TICKS_PER_CHUNK + TICKS_PER_CHUNK - 1)
    days = last.select(
        *keys, "_last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / TICKS_PER_CHUNK))).alias("_day")
    ).where(last_tick >= 1)
    # Days are dealt out before their ticks are made.
    days = days.repartition(*keys, "_day")
    ticks = F.explode(F.sequence(first_tick.cast("bigint"), last_tick.cast("bigint")))
    grid = days.select(*keys, F.col("_day").cast("bigint").alias("_day"), ticks.alias("tick"))
    daily = per_tick.groupBy(*keys, day.alias("_day")).agg(F.sum("change").alias("_change"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    all_days = days.select(*keys, F.col("_day").cast("bigint").alias("_day")).join(daily, [*keys, "_day"], "left")
    carried = all_days.select(*keys, "_day", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_day").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = grid.join(per_tick, [*keys, "tick"], "left").withColumn(
        "_here", F.sum(F.coalesce("change", F.lit(0))).over(inside)
    )
    return running.join(carried, [*keys, "_day"]).select(*keys, "tick", (F.col("_here") + F.col("_carried")).alias("online"))


def update_bursts(
    events: DataFrame,
    partition: tuple[str, ...] = (),
    ts: str = "ts",
    gap_seconds: int = 1,
    ranges: int | None = None,
) -> DataFrame:
    """(burst_start, burst_end, changes): events of one group with no more than ``gap_seconds`` between.

    The same bursts as ``session_window`` makes, for groups of any size.  Events at one moment are
    counted together first.  Each range of a group finds its own bursts; only the first and the last of a range can go on in
    the ranges around it, so one small row per range tells which of these are one.
    """
    keys = list(partition)
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    moments = events.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("_group", "_bucket").orderBy(ts)
    before = F.lag(ts).over(inside)
    starts = F.when(before.isNull() | (F.col(ts) > before + gap), 1).otherwise(0)
    parts = (
        in_order(moments, keys, [ts], ranges).frame.withColumn("_starts", starts)
        .withColumn("_place", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_group", "_bucket", "_place")
        .agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.sum("n").alias("n"))
    )
    along = Window.partitionBy("_group").orderBy("_bucket")
    last = F.lag("_last").over(along)
    borders = (
        parts.groupBy("_group", "_bucket")
        .agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.max("_place").alias("_count"))
        .withColumn("_apart", F.when(last.isNull() | (F.col("_first") > last + gap), 1).otherwise(0))
        .withColumn("_split", F.when(F.col("_count") > 1, 1).otherwise(0))
        # Numbers of the bursts at borders: one more where the next range begins apart, and one more within a range of several.
        .withColumn("_tail", F.sum(F.col("_apart") + F.col("_split")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("_group", "_bucket", "_count", "_tail", (F.col("_tail") - F.col("_split")).alias("_head"))
    )
    number = F.when(F.col("_place") == 1, F.struct(F.lit(-1).alias("_bucket"), F.col("_head").alias("_number"))).when(
        F.col("_place") == F.col("_count"), F.struct(F.lit(-1).alias("_bucket"), F.col("_tail").alias("_number"))
    )
    own = F.struct(F.col("_bucket"), F.col("_place").alias("_number"))
    return (
        parts.join(borders, ["_group", "_bucket"])
        .groupBy(*keys, F.coalesce(number, own).alias("_burst"))
        .agg(F.min("_from").alias("burst_start"), (F.max("_to") + gap).alias("burst_end"), F.sum("n").alias("changes"))
        .drop("_burst")
    )


def merge_bursts(parts: DataFrame, partition: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Bursts from parts of them (burst_start, burst_end, changes): parts that touch or overlap are one.

    Parts may come in any order and any number; the union does not depend on either.  A burst starts where no part before reaches
    to; how far those of earlier ranges reach, and how many bursts began in them, comes from one small row per range.
    """
    keys, order = list(partition), ["burst_start", "burst_end"]
    placed = in_order(parts.select(*keys, *order, F.col("changes").cast("bigint").alias("changes")), keys, order, ranges).frame
    before = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(*before)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order)
    reach = (
        placed.groupBy("_group", "_bucket")
        .agg(F.max("burst_end").alias("_end"))
        .select("_group", "_bucket", F.max("_end").over(earlier).alias("_reach"))
    )
    reached = F.greatest(F.max("burst_end").over(inside.rowsBetween(*before)), "_reach")
    own = (
        placed.join(reach, ["_group", "_bucket"])
        .withColumn("_reached", reached)
        .withColumn("_starts", F.when(F.col("_reached").isNull() | (F.col("burst_start") > F.col("_reached")), 1).otherwise(0))
        .withColumn("_place", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_group", "_bucket", "_place")
        .agg(F.min("burst_start").alias("burst_start"), F.max("burst_end").alias("burst_end"), F.sum("changes").alias("changes"))
    )
    # A range's place 0 goes on with the last burst of the ranges before.
    begun = (
        own.groupBy("_group", "_bucket")
        .agg(F.max("_place").alias("_count"))
        .select("_group", "_bucket", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_begun"))
    )
    return (
        own.join(begun, ["_group", "_bucket"])
        .groupBy(*keys, (F.col("_begun") + F.col("_place")).alias("_burst"))
        .agg(F.min("burst_start").alias("burst_start"), F.max("burst_end").alias("burst_end"), F.sum("changes").alias("changes"))
        .drop("_burst")
    )
