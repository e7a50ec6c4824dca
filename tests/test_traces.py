import datetime as dt
import math
import random

import pytest
from rows import values
from pyspark.sql import functions as F

from quern.operators import traces
from quern.plans.views import table
from quern.sources import jobs as job_sources
from quern.sources import sinks
from quern.streaming import tasks


def ids(spark, n, parts=3):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "job_id")


def test_profiles_are_plausible_and_do_not_depend_on_partitions(spark):
    found = traces.gen_job_profiles(ids(spark, 800)).orderBy("job_id").collect()
    assert found == traces.gen_job_profiles(ids(spark, 800, 8), ranges=9).orderBy("job_id").collect()
    assert [r.join_time for r in found[:2]] == [5.0, 5.0]
    assert all(a.join_time <= b.join_time for a, b in zip(found, found[1:]))
    assert 110 < (found[-1].join_time - 5) / 798 < 150
    for r in found:
        map_time, red_time = traces.TASK_SECONDS[r.job_class]
        run = 2.5 * map_time + 0.5 * red_time
        assert run <= r.deadline <= math.ceil(2 * run) and r.priority in (1, 2, 3, 4, 5)
        assert {0: 2 < r.sensitivity < 8, 1: 0 < r.sensitivity < 0.1, 2: r.sensitivity == 0}[r.deadline_type]
    kinds = [sum(r.deadline_type == k for r in found) / 800 for k in (0, 1, 2)]
    assert kinds == pytest.approx([0.2, 0.6, 0.2], abs=0.06)
    assert found != traces.gen_job_profiles(ids(spark, 800), seed=1).orderBy("job_id").collect()


def test_sensitivities_are_kept_or_redrawn(spark):
    rows = [(0, 0, 4.0), (1, 0, 2.0), (2, 1, 0.5), (3, 1, -1.0), (4, 2, 9.0)]
    rows = [(i, t, 0, b) for i, t, b in rows] + [(5, 0, 1, -0.8), (6, 0, 1, -1.0), (7, 1, 1, -0.2), (8, 1, 1, -0.1), (9, 2, 1, 3.0)]
    df = spark.createDataFrame(rows, "job_id long, deadline_type int, utility_type int, sensitivity double")
    found = {r.job_id: r.sensitivity for r in traces.repair_sensitivity(df).collect()}
    assert (found[0], found[2], found[4], found[5], found[7], found[9]) == (4.0, 0.5, 0.0, -0.8, -0.2, 0.0)
    assert 2 < found[1] < 8 and 0 < found[3] < 0.1 and -1 <= found[6] <= -0.7 and -0.4 <= found[8] <= -0.1


def timeline(spark, rows):
    df = spark.createDataFrame(rows, "start double, lasts double")
    return values(traces.concurrency_timeline(df, F.col("start"), F.col("lasts")))


def test_timeline_counts_every_tick(spark):
    found = timeline(spark, [(5.0, 3.0), (5.0, 6.0)])
    assert dict(found) == {**{t: 0 for t in range(1, 6)}, 6: 2, 7: 2, 8: 2, 9: 1, 10: 1, 11: 1, 12: 0}


def test_timeline_over_several_days(spark, monkeypatch):
    monkeypatch.setattr(traces, "TICKS_PER_CHUNK", 7)
    random.seed(4)
    rows = [(random.random() * 60, random.random() * 40) for _ in range(30)] + [(0.0, 0.5)]
    last = max(math.floor(s + d) + 1 for s, d in rows)
    plain = {t: sum(s < t <= s + d for s, d in rows) for t in range(1, last + 1)}
    assert dict(timeline(spark, rows)) == plain


MOMENT = dt.datetime(2024, 1, 1, 12, 0, 0)


def moments(*seconds):
    return [MOMENT + dt.timedelta(seconds=s) for s in seconds]


@pytest.mark.parametrize("ranges", [1, 3])
def test_bursts_end_after_a_quiet_gap(spark, ranges):
    df = spark.createDataFrame([(m,) for m in moments(0.0, 0.4, 0.9, 3.0)], "ts timestamp")
    found = values(traces.update_bursts(df, ranges=ranges))
    assert found == [(*moments(0.0, 1.9), 3), (*moments(3.0, 4.0), 1)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_bursts_over_ranges_are_those_of_one_pass(spark, ranges):
    """Bursts within a range, over two and over many, with groups of one event and of many."""
    random.seed(ranges)
    rows = [(g, random.choice((0, 20, 40, 300)) + random.randrange(6) * (1 + g)) for g in range(4) for _ in range(40)]
    rows += [(4, i) for i in range(60)] + [(5, 7)]
    df = spark.createDataFrame([(g, MOMENT + dt.timedelta(seconds=s)) for g, s in rows], "g int, ts timestamp")
    plain = []
    for g in range(6):
        at = sorted(s for h, s in rows if h == g)
        cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] > 2), len(at)]
        plain += [(g, MOMENT + dt.timedelta(seconds=at[a]), MOMENT + dt.timedelta(seconds=at[b - 1] + 2), b - a) for a, b in zip(cuts, cuts[1:])]
    assert values(traces.update_bursts(df, ("g",), gap_seconds=2, ranges=ranges)) == sorted(plain, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_parts_that_touch_or_lie_within_each_other_are_one(spark, ranges):
    random.seed(ranges + 100)
    parts = [(g, a, a + random.choice((1, 2, 5, 60)), random.randrange(1, 4)) for g in (0, 1, None) for a in random.choices(range(400), k=60)]
    parts += [(2, 0, 500, 1)] + [(2, i, i + 1, 1) for i in range(0, 600, 3)]
    moment = lambda s: MOMENT + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(g, moment(a), moment(b), n) for g, a, b, n in parts], "g int, burst_start timestamp, burst_end timestamp, changes int")
    plain = []
    for g in (0, 1, 2, None):
        merged = []
        for _, a, b, n in sorted(p for p in parts if p[0] == g):
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + n]
            else:
                merged.append([a, b, n])
        plain += [(g, moment(a), moment(b), n) for a, b, n in merged]
    assert values(traces.merge_bursts(df, ("g",), ranges=ranges)) == sorted(plain, key=repr)
    assert traces.merge_bursts(df.where("false"), ("g",)).count() == 0


@pytest.mark.parametrize("files", [1, 60])
def test_stream_bursts_equal_batch_bursts(spark, folder, files):
    """However the events lie in files, and with those still open at the end."""
    random.seed(8)
    rows = [(i % 5, MOMENT + dt.timedelta(milliseconds=random.randrange(60_000))) for i in range(200)]
    rows += [(0, m) for m in moments(100.0, 101.0)] + [(9, MOMENT + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "job_id int, ts timestamp")
    df.repartition(files, F.md5(F.col("ts").cast("string"))).write.parquet(folder + "/events")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 7).parquet(folder + "/events")
    tasks.stream_update_bursts(stream, folder + "/out", folder + "/progress", keys=("job_id",)).awaitTermination()
    levels = tasks.burst_levels(folder + "/out", ("job_id",))
    parts, batch = levels.open_parts(spark), values(traces.update_bursts(df, ("job_id",)))
    assert values(levels.result(spark)) == values(traces.merge_bursts(parts, ("job_id",))) == batch
    assert values(traces.merge_bursts(parts, ("job_id",), ranges=40)) == batch
    assert sum(r[-1] for r in batch) == len(rows)


def test_timeline_of_epoch_seconds(spark):
    start = 1_700_000_000
    df = spark.createDataFrame([(start + 0.5, 2.0), (start + 1.0, 1.0)], "join_time double, deadline double")
    late = traces.concurrency_timeline(df, F.col("join_time") - (start - 5), F.col("deadline"))
    assert [r.online for r in late.orderBy("tick").collect()][-4:] == [0, 1, 2, 0] or late.count() == 8
    schema = dict(traces.concurrency_timeline(df, F.col("join_time"), F.col("deadline")).dtypes)
    assert schema["tick"] == "bigint"


def test_stream_estimates_equal_batch_over_several_triggers(spark, folder):
    rows = [(i % 4, i % 3 == 0, i % 5 > 0, float(i % 37)) for i in range(120)]
    df = spark.createDataFrame(rows, "job_id long, is_map boolean, succeeded boolean, run_time double")
    df.repartition(6).write.parquet(folder + "/events")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder + "/events")
    priors = (F.lit(40), F.lit(80))
    tasks.update_into(tasks.stream_task_estimate(stream, *priors), folder + "/out", folder + "/progress").awaitTermination()
    updates = spark.read.parquet(folder + "/out")
    assert updates.select("batch").distinct().count() > 1
    assert values(tasks.latest(updates)) == values(tasks.stream_task_estimate(df, *priors))


LOG = "[INFO ] 2014-05-01 10:00:00 - Job Complete Event: 120.5\t-3.25\t0.75\t-0.25\tq7\t100\t20\t210.0\t55.5\t3.0\t1\t0\t0.04\tjobs.WordCount\tjob1"


def test_result_log(spark, folder):
    df = spark.createDataFrame([(LOG,), ("[INFO ] other line",)], "value string")
    df.coalesce(1).write.text(folder + "/raw")
    import glob
    import os
    import shutil

    os.mkdir(folder + "/logs")
    shutil.copy(glob.glob(folder + "/raw/part-*")[0], folder + "/logs/Result-EDF-20.log")
    found = job_sources.result_log_source(spark, folder + "/logs").collect()
    assert len(found) == 1
    row = found[0]
    assert (row.policy, row.iteration, row.exec_time, row.queue_id) == ("EDF", 20, 120.5, "q7")
    assert (row.deadline, row.join_time, row.job_name) == (210.0, 55.5, "job1")


def test_profiles_round_trip_and_fail_on_a_bad_line(spark, folder, lines):
    profiles = traces.gen_job_profiles(ids(spark, 40)).drop("job_id")
    sinks.job_profile_sink(profiles, folder + "/profiles")
    assert values(job_sources.job_profile_source(spark, folder + "/profiles")) == values(profiles)
    with pytest.raises(Exception, match="malformed job profile"):
        job_sources.job_profiles(lines("1 2 3")).collect()


def test_result_and_key_value_sinks(spark, folder):
    row = spark.createDataFrame(
        [(1.5, -0.5, 0.25, 100, 20, 210.0, 5.0, 3.0, 1, "jobs.WordCount")],
        "exec_time double, latency double, utility double, map_tasks int, red_tasks int, deadline double, join_time double, "
        "priority double, deadline_type int, job_class string",
    )
    for _ in range(2):
        sinks.job_result_sink(row, folder + "/results")
    assert values(spark.read.text(folder + "/results")) == [("1.5\t-0.5\t0.25\t100\t20\t210.0\t5.0\t3.0\t1\tWordCount",)]
    counts = spark.createDataFrame([("a", "b", 2)], "w string, doc string, n int")
    sinks.kv_text_sink(counts, folder + "/kv", ("w", "doc"), ("n",))
    assert values(spark.read.text(folder + "/kv")) == [("a|b\t2",)]


def test_tables_are_read_with_pruned_columns(spark):
    from quern.operators.text import word_count

    plan = word_count(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_policy_and_iteration_come_from_the_name_of_the_log(spark, folder):
    """Files and folders of files, policies with hyphens, spaces and plus signs; other files have neither."""
    done = "x - Job Complete Event: 2.0\t0.5\t0.5\t-0.25\tq\t1\t1\t9.0\t{}.0\t1.0\t1\t0\t0.04\tjobs.A\tj"
    for i, name in enumerate(("Result-EDF-3.log", "Result-a b+c-d-12.log", "General-EDF-3.log")):
        with open(f"{folder}/{name}", "w") as f:
            f.write("x - Job Start Event: nothing\n" + done.format(i) + "\n")
    found = job_sources.result_log_source(spark, folder).select("policy", "iteration", "join_time")
    assert values(found) == sorted([("EDF", 3, 0.0), ("a b+c-d", 12, 1.0), ("", None, 2.0)], key=repr)
    logs = spark.createDataFrame([("P q-1", i % 2, done.format(i)) for i in range(6)], "policy string, iteration int, value string")
    sinks.result_log_sink(logs, folder + "/out")
    again = job_sources.result_log_source(spark, folder + "/out")
    assert values(again.select("policy", "iteration", "join_time")) == sorted([("P q-1", i % 2, float(i)) for i in range(6)], key=repr)
    timeline = traces.concurrency_timeline(again, F.col("join_time"), F.col("exec_time"), ("policy", "iteration"))
    assert [(r.tick, r.online) for r in timeline.where("iteration = 1").orderBy("tick").collect()] == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 0)]
