"""What the operators of this folder share: tables, written tables, and whole texts as bytes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import shared_dir

SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame into the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them.  The folder has a name of its own for every call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


ROW_TYPE = "struct<file:string,row:long>"


def private_name(docs: DataFrame, wanted: str = "_row") -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in docs.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """The frame with a column of ``ROW_TYPE`` that tells its rows apart, the same each time it is read.

    Rows of Parquet files are named by file and place; any other frame is written once, with numbers.
    """
    if "_metadata" not in docs.columns:
        try:
            return docs.select("*", F.struct(F.md5("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
        except AnalysisException:
            pass
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return written(docs.withColumn(name, number), "rows")


@lru_cache
def _archive(application: str) -> str:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern"), "zip", root, "quern")


# What operators keep in a Python worker from task to task: a name, and how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keep_in_worker(name: str, let_go: Callable[[], None]) -> None:
    _kept[name] = let_go


def let_go_but(name: str | None) -> None:
    """Spark uses a worker again for other operators; what they do not need would lie beside their own data."""
    for other, let_go in _kept.items():
        if other != name:
            let_go()
    pa.default_memory_pool().release_unused()


def on_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None
) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors, which need not have it installed.

    A worker lets go of what other operators have kept in it; ``keeps`` names what this one goes on with.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_but(keeps)
        yield from run(batches)

    context = df.sparkSession.sparkContext
    archive = _archive(context.applicationId)
    if not any(f.endswith(os.path.basename(archive)) for f in context.listFiles):
        context.addPyFile(archive)
    return df.mapInArrow(task, schema)


def shuffle_parts(df: DataFrame) -> int:
    """Partitions of a shuffle by number, which adaptive execution does not merge."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null is an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def text_runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """The texts of rows start .. stop, about ``most`` bytes at a time, so that a batch is not held twice as objects."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for start, stop in pieces(sizes, most):
        yield start, stop, texts_of(texts.slice(start, stop - start))


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes; a larger row is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
