"""Utility of a job that ends at a given time, and related job-table columns.

P is the priority, beta the sensitivity, D the current deadline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.numeric import round2

# Codes of the job tables.
SIGMOID, LINEAR = 0, 1
HARD, SOFT, NO_DEADLINE = 0, 1, 2
# Fixed value: utilities are inverted inside this share of the priority.
GRACE = 0.9995


def _linear(delay: Column) -> Column:
    return F.when(delay < 0, F.col("sensitivity") * delay + F.col("priority")).otherwise(0.0)


def _logistic(delay: Column) -> Column:
    return 1 / (1 + F.exp(F.col("sensitivity") * delay))


def utility(finish: Column) -> Column:
    """Linear: beta*delay + P before the deadline, else 0.  Sigmoid: P*(logistic - 1) - 1."""
    delay = finish - F.col("deadline")
    return F.when(F.col("utility_type") == LINEAR, _linear(delay)).otherwise(
        F.col("priority") * (_logistic(delay) - 1) - 1
    )


def utility_readable(finish: Column) -> Column:
    """As ``utility`` but the sigmoid is P*(logistic - 0.5), and 0 without a deadline."""
    delay = finish - F.col("deadline")
    return (
        F.when(F.col("utility_type") == LINEAR, _linear(delay))
        .when(F.col("deadline_type") == NO_DEADLINE, 0.0)
        .otherwise(F.col("priority") * (_logistic(delay) - 0.5))
    )


def invert_utility(u: Column) -> Column:
    """Time at which the sigmoid reaches ``u``; a utility above P is an error.

    ``u`` is first brought into the grace region.  With beta = 0 the time is infinite,
    with the sign of the logarithm.
    """
    priority, beta = F.col("priority"), F.col("sensitivity")
    inside = F.greatest(F.least(u, GRACE * priority), (1 - GRACE) * priority)
    log_odds = F.log(priority / inside - 1)
    infinite = F.when(log_odds > 0, float("inf")).when(log_odds < 0, float("-inf")).otherwise(float("nan"))
    time = F.when(beta == 0, infinite).otherwise(F.try_divide(log_odds, beta) + F.col("deadline"))
    too_high = F.raise_error(F.concat(F.lit("utility above the priority of job "), F.col("job_id").cast("string")))
    return F.when(u > priority, too_high.cast("double")).otherwise(time)


def exec_time(launch_ms: Column, finish_ms: Column) -> Column:
    """Seconds between launch and finish, 0 while the job is not done."""
    return F.when(finish_ms.isNull(), 0.0).otherwise(round2((finish_ms - launch_ms) / 1000.0))


def latency(launch_ms: Column, finish_ms: Column, deadline: Column) -> Column:
    """Seconds past the submitted deadline, 0 while the job is not done."""
    return F.when(finish_ms.isNull(), 0.0).otherwise(round2((finish_ms - launch_ms) / 1000.0 - deadline))


def round_up(mean: Column, step: int) -> Column:
    """Next multiple of ``step`` above ``mean``, also for a multiple."""
    return (mean + (step - mean % step)).cast("double")


def task_demand(step: int, rem_map: str = "rem_map", rem_red: str = "rem_red") -> Column:
    """Slots still needed, in units of ``step`` seconds."""
    return F.col(rem_map) * F.floor(F.col("est_map") / step) + F.col(rem_red) * F.floor(F.col("est_red") / step)


def demand_delay(demand: Column, capacity: int, step: int) -> Column:
    """Seconds the whole cluster needs for a demand."""
    return F.ceil(demand / float(capacity)) * float(step)
