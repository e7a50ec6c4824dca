import os
import subprocess
import sys

import pytest

from quern import session


class Fake:
    """A session of a cluster, with the settings given."""

    def __init__(self, spark, master, **conf):
        self.conf, self.sparkContext = conf, spark.sparkContext
        self.sparkContext = type("Context", (), {"master": master, "_jvm": spark._jvm, "_jsc": spark.sparkContext._jsc})()


@pytest.mark.parametrize("path", ["/tmp/x", "file:///tmp/x"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, path):
    with pytest.raises(ValueError, match="one machine"):
        session.shared_dir(Fake(spark, "spark://host:7077", **{"spark.checkpoint.dir": path}))
    mounted = Fake(spark, "spark://host:7077", **{"spark.checkpoint.dir": path, "spark.quern.sharedMount": "true"})
    assert session.shared_dir(mounted) == path
    assert session.shared_dir(Fake(spark, "local[2]", **{"spark.checkpoint.dir": path})) == path


def test_the_setting_is_required_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake(spark, "yarn"))


ON_A_CLUSTER = """
import os, sys
os.chdir(sys.argv[2])
sys.path[:0] = [sys.argv[1], sys.argv[1] + "/tests"]
from quern import session
from test_session import Fake

conf = {"spark_ui_enabled": "false", "spark_driver_host": "127.0.0.1", "spark_executor_memory": "512m", "spark_local_dir": sys.argv[2]}
spark = session.session("folders", master="local-cluster[2,1,1024]", **conf)
found = []
for path in (sys.argv[2] + "/shared", "file:///proc/self/cwd/own"):
    try:
        found.append(session.shared_dir(Fake(spark, "spark://host:7077", **{"spark.checkpoint.dir": path})) == path)
    except ValueError as e:
        found.append("one machine" in str(e) and "refused")
spark.stop()
print(found)
"""


def test_a_folder_that_all_executors_reach_is_taken(folder):
    """The second folder is another one for every process."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", ON_A_CLUSTER, root, folder],
        env=os.environ | {"SPARK_WORKER_DIR": f"{folder}/workers"}, capture_output=True, text=True, timeout=120,
    )
    assert run.stdout.split("\n")[-2:] == ["[True, 'refused']", ""], run.stderr[-2000:]
