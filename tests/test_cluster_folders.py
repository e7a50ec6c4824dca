"""The queries of ``test_cluster`` where the folder named in ``spark.checkpoint.dir`` is another one for every process."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from test_cluster import ON_A_CLUSTER, TABLES

NAMES = (
    "classify_by_file",
    "good_rows",
    "job_result_sink",
    "kmeans_iterate",
    "kmeans_update",
    "kv_text_sink",
    "load_centroids",
    "malformed_edges",
    "result_log_files",
    "result_log_timeline",
    "sort_pipeline",
    "stream_malformed_edges",
    "stream_task_estimate",
)
OWN_FOLDERS = ON_A_CLUSTER.replace('f"file://{folder}/shared"', '"file:///proc/self/cwd/own"')
SET_LATER = """
import os, sys
os.chdir(sys.argv[2])
sys.path.insert(0, sys.argv[1])
from pyspark import SparkContext
from quern.session import session, shared_dir

conf = {"spark_ui_enabled": "false", "spark_driver_host": "127.0.0.1", "spark_executor_memory": "512m", "spark_local_dir": sys.argv[2]}
spark = session("folders", master="local-cluster[2,1,1024]", spark_checkpoint_dir="file:///proc/self/cwd/own", **conf)
SparkContext.master = property(lambda self: "spark://host:7077")
found = [shared_dir(spark)]
spark.sparkContext.setCheckpointDir(f"file://{sys.argv[2]}/later")
found.append(shared_dir(spark))
spark.stop()
print(found)
"""


def run(script, folder, *rest):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_WORKER_DIR": f"{folder}/workers"}
    done = subprocess.run([sys.executable, "-c", script, root, folder, *rest], env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.splitlines()[-1]


@pytest.fixture(scope="module")
def differences(tmp_path_factory):
    """By query, what differs from its SQL."""
    folder = str(tmp_path_factory.mktemp("folders"))
    os.mkdir(f"{folder}/tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name, rows in TABLES.items():
        con.execute(f"copy ({rows}) to '{folder}/tables/{name}.parquet'")
    assert OWN_FOLDERS != ON_A_CLUSTER
    return json.loads(run(OWN_FOLDERS, folder, *NAMES))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_where_only_the_warehouse_is_shared(differences, name):
    assert differences[name] == ""


def test_a_folder_set_later_holds_instead_of_the_setting(folder):
    first, later = eval(run(SET_LATER, folder))
    assert first == f"file:{folder}/spark-warehouse/quern"
    assert later.startswith(f"file:{folder}/later/")
