import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import values

from quern.operators.counters import StreamCounters
from quern.operators.traces import merge_bursts
from quern.streaming import tasks
from quern.streaming.levels import covering

START = dt.datetime(2024, 1, 1)
PARTS = "job_id long, burst_start timestamp, burst_end timestamp, changes long"


def test_few_folders_cover_many_triggers():
    for fanout in (2, 8):
        for triggers in range(1, 1100):
            found = covering(triggers, fanout)
            levels = len({level for level, _ in found})
            assert len(found) <= (fanout - 1) * levels and fanout ** (levels - 1) <= triggers
            assert found[-1][1] == triggers - 1 and sum(fanout**level for level, _ in found) == triggers
    assert len(covering(1000)) == 1 + 7 + 5 + 0


def test_bursts_of_many_triggers_are_those_of_all_events(spark, folder):
    """Triggers bring events out of order and late; merged by levels they give the bursts of one pass."""
    seconds = [(i * 7919) % 3000 for i in range(130)]
    levels = tasks.burst_levels(folder + "/bursts", ("job_id",), fanout=4)
    parts = [(i % 2, START + dt.timedelta(seconds=s), START + dt.timedelta(seconds=s + 30), 1) for i, s in enumerate(seconds)]
    for trigger in range(13):
        levels.add(spark.createDataFrame(parts[trigger * 10 : trigger * 10 + 10], PARTS), trigger)
    assert levels.triggers(spark) == 13
    whole = merge_bursts(spark.createDataFrame(parts, PARTS), ("job_id",))
    assert values(levels.result(spark).select("job_id", "burst_start", "burst_end", "changes")) == values(whole.select("job_id", "burst_start", "burst_end", "changes"))
    # A trigger that runs again changes nothing.
    levels.add(spark.createDataFrame(parts[120:], PARTS), 12)
    assert levels.result(spark).count() == whole.count()


def totals(spark, *rows):
    schema = "job_id long, is_map boolean, run_time decimal(38,6), tasks long, map_prior int, red_prior int, last timestamp"
    from decimal import Decimal

    made = [(j, True, Decimal(t), 1, 20, 30, START + dt.timedelta(hours=h)) for j, t, h in rows]
    return spark.createDataFrame(made, schema)


def test_ended_jobs_leave_the_open_parts_and_late_events_still_count(spark, folder):
    levels = tasks.total_levels(folder + "/totals", idle="1 day", fanout=2)
    open_rows = []
    # Job n has its events in trigger n alone, a day and a half after the job before; job 0 comes back at the end.
    for trigger in range(16):
        levels.add(totals(spark, (trigger, 10, 36 * trigger), (trigger, 5, 36 * trigger)), trigger)
        open_rows.append(levels.open_parts(spark).select("job_id").distinct().count())
    levels.add(totals(spark, (0, 100, 0)), 16)
    assert max(open_rows) <= 4 and open_rows[15] == 1
    found = {r.job_id: (r.run_time, r.tasks) for r in levels.result(spark).collect()}
    assert found == {0: (115, 3)} | {j: (15, 2) for j in range(1, 16)}


def test_estimates_of_the_stream_are_those_of_the_table(spark, folder):
    rows = [(j % 5, j % 2 == 0, j % 7 != 0, float(j), START + dt.timedelta(minutes=j), 20, 30) for j in range(200)]
    df = spark.createDataFrame(rows, "job_id long, is_map boolean, succeeded boolean, run_time double, ts timestamp, map_prior int, red_prior int")
    df.repartition(12).write.parquet(folder + "/events")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/events")
    tasks.stream_task_totals(stream, folder + "/state", folder + "/progress", idle="1 hour", fanout=3).awaitTermination()
    levels = tasks.total_levels(folder + "/state", "1 hour", 3)
    assert levels.triggers(spark) >= 12
    whole = tasks.stream_task_estimate(df, F.max("map_prior"), F.max("red_prior"))
    assert values(tasks.task_estimates(levels.result(spark))) == values(whole)


def test_counts_of_a_stream(spark, folder):
    spark.createDataFrame([(i,) for i in range(100)], "n int").repartition(4).write.parquet(folder + "/in")
    for part in range(2):
        raw = spark.readStream.schema("n int").option("maxFilesPerTrigger", 2 - part).parquet(folder + "/in")
        seen = raw.observe("seen", F.count(F.lit(1)).alias("n")).where("n >= 10").observe("kept", F.count(F.lit(1)).alias("n"))
        with StreamCounters(spark) as counters:
            writer = seen.writeStream.option("checkpointLocation", f"{folder}/at{part}").trigger(availableNow=True)
            query = writer.start(f"{folder}/out{part}", format="parquet")
            query.awaitTermination()
            assert counters.totals(query) == {"seen": 100, "kept": 90}
        assert spark.read.parquet(f"{folder}/out{part}").count() == 90


def test_counts_of_a_query_that_did_not_end(spark):
    with pytest.raises(TimeoutError):
        StreamCounters(spark).totals(type("Query", (), {"id": "none"})(), patience=0.01)
