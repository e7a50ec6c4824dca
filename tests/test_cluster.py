"""Queries that write to the shared folder, on executors that are processes of their own and a master that is not local."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

NAMES = (
    "classify_by_file", "good_rows", "job_result_sink", "kmeans_iterate", "kmeans_update", "kv_text_sink",
    "load_centroids", "malformed_edges", "result_log_files", "result_log_timeline", "sort_pipeline",
    "stream_malformed_edges", "stream_task_estimate",
)

TABLES = {
    "customer": "select i as c_custkey from range(40) r(i)",
    "orders": """
        select i as o_orderkey, i * 7 % 40 as o_custkey, substr('FOP', 1 + i % 3, 1) as o_orderstatus, cast(900.25 + i * 37.5 as double) as o_totalprice,
               concat(1 + i % 5, '-RANK') as o_orderpriority
        from range(300) r(i)""",
    "lineitem": """
        select i % 300 as l_orderkey, i * 11 % 210 as l_partkey, i % 13 as l_suppkey, cast(1 + i % 7 as int) as l_linenumber,
               cast(1 + i % 50 as double) as l_quantity, substr('ANR', 1 + i % 3, 1) as l_returnflag
        from range(1200) r(i)""",
    "events": """
        select timestamptz '2024-01-01 00:00:00+00' + to_seconds(i * 400) as ts, i * 3 % 45 as user_id,
               ['view', 'click', 'error', 'signup'][1 + i % 4] as event_type, cast(i % 90 as double) + 0.25 as value
        from range(500) r(i)""",
    "documents": "select i as doc_id, concat('a', i, ',b', i % 3, chr(10), 'no comma', chr(10), 'x,y,', i) as text, 's' as source from range(60) r(i)",
}

ON_A_CLUSTER = """
import json, os, sys
root, folder, names = sys.argv[1], sys.argv[2], sys.argv[3:]
os.chdir(folder)
sys.path[:0] = [root, root + "/tests"]
import duckdb
from check import compare
from pyspark import SparkContext
from quern.session import session

settings = {
    "spark_ui_enabled": "false", "spark_driver_host": "127.0.0.1", "spark_driver_memory": "2g", "spark_executor_memory": "768m",
    "spark_sql_shuffle_partitions": "2", "spark_local_dir": folder, "spark_checkpoint_dir": f"file://{folder}/shared",
}
spark = session("cluster", master="local-cluster[2,1,1024]", **settings)
SparkContext.master = property(lambda self: "spark://host:7077")
con = duckdb.connect()
con.execute("set timezone = 'UTC'")
for name in os.listdir(f"{folder}/tables"):
    con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/tables/{name}'")
found = {}
for name in names:
    try:
        found[name] = compare(spark, con, name, f"{folder}/tables")
    except Exception as error:
        found[name] = f"{type(error).__name__}: {str(error)[:300]}"
spark.stop()
print(json.dumps(found))
"""


@pytest.fixture(scope="module")
def differences(tmp_path_factory):
    """By query, what differs from its SQL."""
    folder = str(tmp_path_factory.mktemp("cluster"))
    os.mkdir(f"{folder}/tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name, rows in TABLES.items():
        con.execute(f"copy ({rows}) to '{folder}/tables/{name}.parquet'")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", ON_A_CLUSTER, root, folder, *NAMES],
        env=os.environ | {"SPARK_WORKER_DIR": f"{folder}/workers"}, capture_output=True, text=True, timeout=400,
    )
    assert run.returncode == 0, run.stderr[-2000:]
    return json.loads(run.stdout.splitlines()[-1])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_a_cluster(differences, name):
    assert differences[name] == ""
