"""The tables, and views over them in the shapes the operators take.

Each view is one SQL text, with the tables in braces, that runs on both sides of the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.traces import TASK_SECONDS, TRACE_CLASSES


def _by_class(place: int) -> str:
    arms = " ".join(f"when {i} then {TASK_SECONDS[c][place]}" for i, c in enumerate(TRACE_CLASSES))
    return f"cast(case c_custkey % {len(TRACE_CLASSES)} {arms} end as int)"


# Movies whose reviews are the first centroids of the queries: the model they are run with, eight clusters.
FIRST_CENTROIDS = (5, 17, 42, 77, 101, 128, 150, 199)
_CLUSTER_OF = " ".join(f"when {m} then {k}" for k, m in enumerate(sorted(FIRST_CENTROIDS, reverse=True)))

VIEWS = {
    "ratings": """
        select l_partkey as movie_id, o_custkey % 200 as rater_id,
               cast(1 + (l_linenumber * 7 + l_suppkey) % 5 as int) as rating
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "centroids": f"""
        select cast(case l_partkey {_CLUSTER_OF} end as int) as k, o_custkey % 200 as rater_id,
               min(cast(1 + (l_linenumber * 7 + l_suppkey) % 5 as int)) as c_rating
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey
        where l_partkey in {FIRST_CENTROIDS} group by 1, 2""",
    "itemsets": """
        select concat(cast(l_orderkey as varchar(20)), ',', l_returnflag) as prefix,
               cast(l_partkey as varchar(20)) as item
        from {lineitem}""",
    "edges": """
        select cast(l_partkey % 500 as varchar(20)) as src, cast(l_suppkey as varchar(20)) as dst
        from {lineitem}""",
    "job_snapshots": """
        select o_custkey % 50 as snapshot_id, o_orderkey as job_id,
               cast(100 + o_orderkey % 90 as int) as rem_map, cast(10 + o_orderkey % 11 as int) as rem_red,
               cast(20 + 10 * (o_orderkey % 5) as double) as est_map,
               cast(70 + 10 * (o_orderkey % 7) as double) as est_red,
               cast(200 + o_orderkey % 997 as double) as deadline,
               cast(o_orderkey % 10007 as double) as join_time,
               cast(1 + o_orderkey % 5 as double) as priority, cast(o_orderkey % 3 as int) as deadline_type,
               cast(case when o_orderkey % 4 = 3 then 1 else 0 end as int) as utility_type,
               case when o_orderkey % 4 = 3 then cast(-0.2 as double)
                    when o_orderkey % 3 = 0 then cast(5.0 as double)
                    when o_orderkey % 3 = 1 then cast(0.04 as double) else cast(0.0 as double) end as sensitivity
        from {orders}""",
    "job_runs": """
        select o_orderkey as job_id, cast(o_orderkey * 1000 as double) as launch_ms,
               case when o_orderstatus = 'P' then null
                    else cast(o_orderkey * 1000 + round(o_totalprice * 100) as double) end as finish_ms,
               cast(200 + o_orderkey % 997 as double) as deadline
        from {orders}""",
    "task_events": """
        select user_id as job_id, event_type in ('view', 'click') as is_map, event_type <> 'error' as succeeded,
               value as run_time, cast(ts as timestamp) as ts
        from {events}""",
    "planned_jobs": f"""
        select c_custkey as job_id, {_by_class(0)} as map_prior, {_by_class(1)} as red_prior
        from {{customer}}""",
    "sorted_rows": """
        select o_orderstatus as file, o_orderkey as pos, o_orderpriority as key from {orders}""",
    "movie_lines": """
        select concat(cast(l_partkey as varchar(20)), ':', cast(l_suppkey as varchar(20)), '_',
                      cast(l_linenumber as varchar(20)), ',', cast(l_orderkey % 977 as varchar(20)), '_',
                      cast(cast(l_quantity as int) as varchar(20)), ',', cast(l_linenumber as varchar(20))) as value
        from {lineitem}""",
    "mixed_lines": """
        select case when l_orderkey % 29 = 0 then concat(cast(l_partkey as varchar(20)), ' no colon')
                    when l_orderkey % 31 = 0 then ':1_2'
                    else concat(case when l_orderkey % 37 = 0 then 'm' else '' end, cast(l_partkey as varchar(20)), ':',
                                cast(l_suppkey as varchar(20)), '_', case when l_linenumber = 3 then '4.5' else cast(l_linenumber as varchar(20)) end, ',',
                                case when l_orderkey % 11 = 0 then 'r' else '' end, cast(l_orderkey % 977 as varchar(20)), '_',
                                case when l_linenumber = 2 then ' 3' else cast(cast(l_quantity as int) as varchar(20)) end, ',',
                                case when l_orderkey % 7 = 0 then '99999999999' else cast(l_linenumber as varchar(20)) end) end as value
        from {lineitem}""",
    "profile_lines": """
        select concat(cast(100 + o_orderkey % 90 as varchar(20)), ' ', cast(10 + o_orderkey % 11 as varchar(20)), ' ',
                      cast(200 + o_orderkey % 997 as varchar(20)), '.5 ', cast(o_orderkey % 10007 as varchar(20)), '.25 ',
                      cast(1 + o_orderkey % 5 as varchar(20)), '.0 ', cast(o_orderkey % 3 as varchar(20)), ' 0 0.04 ',
                      'jobs.', substr(o_orderstatus, 1, 1), ' job', cast(o_orderkey as varchar(20))) as value
        from {orders}""",
    "result_log_lines": """
        select concat('[INFO ] ', cast(o_orderkey as varchar(20)), ' - ',
                      case when o_orderstatus = 'P' then 'Job Start Event: ' else 'Job Complete Event: ' end,
                      cast(o_totalprice as varchar(30)), chr(9), cast(o_orderkey % 313 as varchar(20)), '.5', chr(9), '0.5', chr(9), '-0.25', chr(9),
                      cast(o_custkey % 10 as varchar(20)), chr(9), '100', chr(9), '20', chr(9),
                      cast(200 + o_orderkey % 997 as varchar(20)), '.0', chr(9), cast(o_orderkey % 10007 as varchar(20)), '.25', chr(9),
                      '3.0', chr(9), '1', chr(9), '0', chr(9), '0.04', chr(9), 'jobs.WordCount', chr(9), 'job',
                      cast(o_orderkey as varchar(20))) as value
        from {orders}""",
    "run_logs": """
        select case o_custkey % 3 when 0 then 'EDF' when 1 then 'RRH-2' else 'a b' end as policy, cast(o_orderkey % 2 as int) as iteration,
               concat('[INFO ] 1 - ', case when o_orderstatus = 'P' then 'Job Start Event: ' else 'Job Complete Event: ' end,
                      cast(cast(floor(o_totalprice / 1000) as int) as varchar(20)), '.5', chr(9), '0.5', chr(9), '0.5', chr(9), '-0.25', chr(9), 'q', chr(9), '100', chr(9), '20',
                      chr(9), '300.0', chr(9), cast(o_orderkey % 10007 as varchar(20)), '.25', chr(9), '3.0', chr(9), '1', chr(9), '0', chr(9), '0.04', chr(9),
                      'jobs.WordCount', chr(9), 'job', cast(o_orderkey as varchar(20))) as value
        from {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(text: str) -> list[str]:
    return [t for t in ("lineitem", "orders", "events", "customer") if f"{{{t}}}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables its text names; only those are read."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables_of(text)})


def view_sql(name: str) -> str:
    text = VIEWS[name]
    return text.format(**{t: t for t in tables_of(text)})


def with_views(names: list[str], body: str, steps: dict[str, str] | None = None) -> str:
    """A SQL text with the named views and further steps in front of ``body``."""
    parts = [f"{n} as ({view_sql(n)})" for n in names]
    parts += [f"{n} as ({text})" for n, text in (steps or {}).items()]
    return f"with recursive {', '.join(parts)} {body}"
