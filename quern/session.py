"""Session defaults and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from functools import lru_cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Whether the executors were seen to share a folder, by application and folder.
_reached: dict[tuple[str, str], bool] = {}


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with the settings the operators rely on.

    On a cluster ``master`` and memory come from ``spark-submit``.  Extra settings are
    given with underscores for dots: ``session(spark_sql_shuffle_partitions="8")``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``SparkContext.setCheckpointDir``, else by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.  On a cluster a folder of the local file system
    must be mounted on all machines.  A short job tries that out once a session, unless ``spark.quern.sharedMount`` is true,
    which says so.  Where no named folder is shared, a folder of the warehouse is, if the executors share that.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.master.startswith("local"):
        return named or _local_dir(context.applicationId)
    mounted = spark.conf.get("spark.quern.sharedMount", "false").lower() == "true"
    given = [folder for folder in (_set_later(context), named) if folder]
    for folder in given:
        if mounted or _is_shared(spark, folder):
            return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if warehouse and _is_shared(spark, place := f"{warehouse.rstrip('/')}/quern"):
        if given:
            warnings.warn(f"{given[0]} is a folder of one machine; {place} is used in its place", stacklevel=2)
        return place
    if given:
        raise ValueError(f"{given[0]} is a folder of one machine; name one that all executors share in spark.checkpoint.dir")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def _set_later(context: SparkContext) -> str | None:
    """The checkpoint folder that was set after the session began, which then holds instead of the setting."""
    now, setting = context._jsc.getCheckpointDir().orNull(), context._jsc.getConf().get("spark.checkpoint.dir", "")
    if not now or not setting:
        return now
    folder = context._jvm.org.apache.hadoop.fs.Path(setting)
    began = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder)
    return None if context._jvm.org.apache.hadoop.fs.Path(now).getParent().equals(began) else now


def _is_shared(spark: SparkSession, folder: str) -> bool:
    return _scheme(spark, folder) != "file" or _reaches_executors(spark.sparkContext._jsc, folder)


def _scheme(spark: SparkSession, path: str) -> str:
    """The file system of a path; one without a scheme lies on the default file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getUri().getScheme()


def _reaches_executors(context: JavaObject, folder: str) -> bool:
    """Whether what tasks on all cores write into a folder is all there when it is read back; without executors there is no telling."""
    place = (context.sc().applicationId(), folder)
    if place in _reached:
        return _reached[place]
    context.parallelize([0]).count()  # waits for the first executor
    if len(context.sc().statusTracker().getExecutorInfos()) < 2:  # the driver is one of them
        return False
    tasks = 2 * context.defaultParallelism()
    probe = f"{folder.rstrip('/')}/probe-{uuid.uuid4().hex}"
    try:
        context.parallelize(list(range(tasks)), tasks).saveAsTextFile(probe)
        _reached[place] = context.textFile(probe, tasks).count() == tasks
    except Py4JJavaError:  # a task could not write there, or misses files of others
        _reached[place] = False
    return _reached[place]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a new folder of the shared folder and read it back, which cuts its lineage.

    Loops use it between passes: the files outlive the executors that wrote them.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@lru_cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"quern-{application}-")
