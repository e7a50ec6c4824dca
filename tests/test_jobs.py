import math
import random

import pytest
from rows import values
from pyspark.sql import functions as F

from quern.functions import scores as S
from quern.functions.numeric import round2
from quern.operators import jobs

SCHEMA = (
    "snapshot_id string, job_id long, rem_map int, rem_red int, est_map double, est_red double, deadline double, "
    "join_time double, priority double, deadline_type int, utility_type int, sensitivity double"
)


def job(snapshot="s", job_id=0, rem_map=100, rem_red=20, est_map=40.0, est_red=80.0, deadline=500.0, join_time=5.0,
        priority=2.0, deadline_type=0, utility_type=0, sensitivity=1.0):
    return (snapshot, job_id, rem_map, rem_red, est_map, est_red, deadline, join_time, priority, deadline_type, utility_type, sensitivity)


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(df, column):
    return df.select(column).first()[0]


def test_round2_ties_go_to_even(spark):
    # The double -0.005 lies below its decimal and is no tie; -0.125 is one.
    df = spark.createDataFrame([(2.125,), (2.375,), (-0.005,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(round2(F.col("x"))).collect()] == [2.12, 2.38, -0.01, -0.12]


def test_utilities(spark):
    at = lambda t: F.lit(float(t))
    sigmoid = frame(spark, job(deadline=0.0))
    assert one(sigmoid, S.utility(at(0))) == -2.0
    assert one(sigmoid, S.utility_readable(at(0))) == 0.0
    linear = frame(spark, job(deadline=0.0, utility_type=1, sensitivity=-0.5))
    assert one(linear, S.utility(at(3))) == 0.0
    assert one(linear, S.utility(at(-3))) == 3.5
    none = frame(spark, job(deadline=0.0, deadline_type=2))
    assert one(none, S.utility_readable(at(-5))) == 0.0
    assert one(sigmoid, S.utility(at(5000))) == -3.0


def test_inverted_utility(spark):
    df = frame(spark, job(deadline=10.0))
    assert one(df, S.invert_utility(F.lit(0.0))) == pytest.approx(10 + math.log(1999))
    assert one(df, S.invert_utility(F.lit(1.0))) == 10.0
    flat = frame(spark, job(sensitivity=0.0))
    assert one(flat, S.invert_utility(F.lit(0.0))) == math.inf
    with pytest.raises(Exception, match="utility above the priority"):
        df.select(S.invert_utility(F.lit(2.5))).collect()


def test_times_of_unfinished_jobs_are_zero(spark):
    df = spark.createDataFrame([(1000.0, 13345.0, 10.0), (0.0, None, 10.0)], "launch_ms double, finish_ms double, deadline double")
    found = jobs.finished_times(df).select("exec_time", "latency")
    assert values(found) == [(0.0, 0.0), (12.35, 2.35)]  # the doubles of 12.345 and 12.345 - 10 are just above their decimals


EVENTS = "job_id long, is_map boolean, succeeded boolean, run_time double"


def test_estimates_always_go_up(spark):
    events = spark.createDataFrame([(1, True, True, 50.0), (1, True, True, 60.0), (1, True, False, 900.0), (1, False, True, 19.9)], EVENTS)
    plan = spark.createDataFrame([(1, 40, 80), (2, 40, 80)], "job_id long, map_prior int, red_prior int")
    found = values(jobs.task_time_estimate(events, plan))
    assert found == [(1, False, 1, 50.0), (1, True, 2, 60.0), (2, False, 0, 90.0), (2, True, 0, 50.0)]


def test_demand_and_horizon(spark):
    df = frame(spark, job(job_id=1), job(job_id=2, rem_map=1, rem_red=0, est_map=59.0))
    found = values(jobs.remaining_demand(df).select("job_id", "demand", "delay"))
    assert found == [(1, 560, 140.0), (2, 5, 10.0)]
    assert values(jobs.horizon_slots(df)) == [("s", math.ceil((400 + 5) / 40 + 160 / 40))]


def plain_backlog(rows, rank):
    finish, scores = 0.0, []
    for r in sorted(rows, key=lambda r: (rank(r), r[1])):
        demand = r[2] * int(r[4] / 10) + r[3] * int(r[5] / 10)
        finish += math.ceil(demand / 40) * 10
        delay = finish - r[6]
        if r[10] == 1:
            u = r[11] * delay + r[8] if delay < 0 else 0.0
            scores.append((u, u))
        else:
            logistic = 1 / (1 + math.exp(min(r[11] * delay, 700)))
            scores.append((r[8] * (logistic - 1) - 1, 0.0 if r[9] == 2 else r[8] * (logistic - 0.5)))
    u, h = zip(*scores)
    return min(u), sum(u), min(h), sum(h)


def random_jobs(n=120):
    random.seed(9)
    rows = []
    for i in range(n):
        kind, linear = random.randrange(3), random.random() < 0.3
        beta = -random.random() if linear else (5.0, 0.04, 0.0)[kind]
        rows.append(job("hot" if i % 3 else f"s{i % 4}", i, random.randrange(1, 100), random.randrange(20), random.choice([20.0, 50.0]), 90.0,
                        float(random.randrange(200, 900)), float(random.randrange(50)), float(random.randrange(1, 6)), kind, int(linear), beta))
    return rows


def plain_rewards(rows):
    rewards = {}
    decay = {r[1]: (r[11] if r[10] == 1 else -r[8] * r[11] / 4) for r in rows}
    for r in rows:
        remaining = r[4] * math.ceil(r[2] / 40) + r[5] * math.ceil(r[3] / 40)
        delay = -r[6]
        if r[10] == 1:
            now, expire = r[11] * delay + r[8], math.inf
        else:
            now = 0.0 if r[9] == 2 else r[8] * (1 / (1 + math.exp(r[11] * delay)) - 0.5)
            expire = math.inf if r[11] == 0 else math.log(r[8] / (0.0005 * r[8]) - 1) / r[11] + r[6]
        cost = sum(decay[j[1]] * min(remaining, expire) for j in rows if j[1] != r[1])
        rewards[r[1]] = (0.3 * now / (1 + 9 * remaining) + 0.7 * cost) / remaining
    return rewards


@pytest.mark.parametrize("ranges", [1, 12])
@pytest.mark.parametrize("name", ["edf", "fifo", "rrh", "rrh_falling"])
def test_backlogs_against_plain_python(spark, name, ranges):
    rows = random_jobs()
    df = frame(spark, *rows)
    run = {
        "edf": lambda: jobs.backlog_edf(df, ranges=ranges),
        "fifo": lambda: jobs.backlog_fifo(df, ranges=ranges),
        "rrh": lambda: jobs.backlog_rrh(df, ranges=ranges),
        "rrh_falling": lambda: jobs.backlog_rrh(df, descending=True, ranges=ranges),
    }[name]()
    for found in run.collect():
        mine = [r for r in rows if r[0] == found.snapshot_id]
        rewards = plain_rewards(mine)
        rank = {"edf": lambda r: r[6], "fifo": lambda r: r[7], "rrh": lambda r: round(rewards[r[1]], 9),
                "rrh_falling": lambda r: -round(rewards[r[1]], 9)}[name]
        assert tuple(found)[1:] == pytest.approx(plain_backlog(mine, rank), abs=0.0051)


def test_rewards_against_plain_python(spark):
    rows = random_jobs()
    for found in jobs.risk_reward_rank(frame(spark, *rows)).collect():
        mine = plain_rewards([r for r in rows if r[0] == found.snapshot_id])
        assert found.reward == pytest.approx(mine[found.job_id], rel=1e-9, abs=1e-9)


def test_summary_of_given_times(spark):
    df = frame(spark, job(job_id=1, deadline=0.0), job(job_id=2, deadline=0.0, utility_type=1, sensitivity=-0.5))
    finish = spark.createDataFrame([("s", 1, 0.0), ("s", 2, -2.0)], "snapshot_id string, job_id long, finish double")
    assert values(jobs.utility_summary(df, finish)) == [("s", -2.0, 1.0, 0.0, 3.0)]


def test_shares(spark):
    df = frame(spark, job(job_id=1, priority=1.0), job(job_id=2, priority=3.0), job(snapshot=None, job_id=3))
    assert values(jobs.priority_share(df).select("job_id", "share")) == [(1, 27), (2, 72), (3, 100)]
    six = frame(spark, *[job(job_id=i) for i in range(6)], *[job("t", job_id=10 + i) for i in range(3)])
    found = {(r.snapshot_id, r.share) for r in jobs.equal_share(six).collect()}
    assert found == {("s", 16.66), ("t", 33.33)}


def test_earliest_deadline_ties_by_id(spark):
    df = frame(spark, job(job_id=7, deadline=50.0, join_time=5.0), job(job_id=3, deadline=45.0, join_time=10.0), job(job_id=1, deadline=60.0))
    assert values(jobs.earliest_deadline(df)) == [("s", 3, 55.0)]


@pytest.mark.parametrize("ranges", [1, 9])
def test_feasibility_against_plain_python(spark, ranges):
    random.seed(2)
    rows = [job(f"s{i % 2}", i, deadline=float(random.choice([200, 400, 800, 5000]))) for i in range(60)]
    plain = {}
    for r in rows:
        due = sum(j[0] == r[0] and j[6] <= r[6] for j in rows)
        plain[r[0]] = plain.get(r[0], 0) + (due * 100 > int(r[6] / 180) * 40)
    assert dict(values(jobs.feasibility(frame(spark, *rows), ranges=ranges))) == plain
