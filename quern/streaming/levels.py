"""Partial results of a stream's triggers, merged level by level.

Each trigger writes its part.  Every ``fanout`` parts of a level are merged into one of the next, so after n triggers a reader finds at
most ``fanout - 1`` folders on each of log(n) levels, and each row has been written log(n) times.  Which folders are merged follows from the
trigger's number alone: one that runs again after a failure writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

FANOUT = 8


def covering(triggers: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(level, last trigger) of the folders that together hold the triggers from 0 on, the highest level first."""
    level = 0
    while fanout ** (level + 1) <= triggers:
        level += 1
    found, at = [], 0
    for here in range(level, -1, -1):
        while at + fanout**here <= triggers:
            at += fanout**here
            found.append((here, at - 1))
    return found


@dataclass(frozen=True)
class Levels:
    """Parts below ``path``, which ``merge`` makes one, in any order and number.

    ``leaves`` says which rows of a merged part are final for now: they go to a folder of their own and are not merged again, only
    read.  Should a later part speak of them after all, ``merge`` puts both together when the result is read.
    """

    path: str
    merge: Callable[[DataFrame], DataFrame]
    fanout: int = FANOUT
    leaves: Callable[[DataFrame], Column] | None = None

    def _folder(self, kind: str, level: int, trigger: int) -> str:
        return f"{self.path}/{kind}/level={level}/trigger={trigger}"

    def add(self, part: DataFrame, trigger: int) -> None:
        """Write the part of a trigger, numbered from 0 without gaps, and merge the levels that are full with it."""
        part.write.mode("overwrite").parquet(self._folder("open", 0, trigger))
        spark, level = part.sparkSession, 1
        while (trigger + 1) % self.fanout**level == 0:
            step = self.fanout ** (level - 1)
            below = [self._folder("open", level - 1, trigger - i * step) for i in range(self.fanout)]
            merged = self.merge(spark.read.parquet(*below))
            target = self._folder("open", level, trigger)
            if self.leaves is None:
                merged.write.mode("overwrite").parquet(target)
            else:
                # One job splits the rows; the folder of those that stay is read alone from then on.
                whole = self._folder("merged", level, trigger)
                merged.withColumn("left", self.leaves(merged)).write.mode("overwrite").partitionBy("left").parquet(whole)
                kept = spark.read.schema(f"{_ddl(merged)}, left boolean").parquet(whole)
                kept.where("not left").drop("left").write.mode("overwrite").parquet(target)
                kept.where("left").drop("left").write.mode("overwrite").parquet(self._folder("closed", level, trigger))
            level += 1

    def open_parts(self, spark: SparkSession) -> DataFrame:
        """The parts that are still merged, as they are."""
        return spark.read.parquet(*[self._folder("open", *f) for f in covering(self.triggers(spark), self.fanout)])

    def triggers(self, spark: SparkSession) -> int:
        return len(_names(spark, f"{self.path}/open/level=0"))

    def result(self, spark: SparkSession) -> DataFrame:
        """All parts merged.  A single part is so already."""
        folders = [self._folder("open", *f) for f in covering(self.triggers(spark), self.fanout)]
        closed = [f"{self.path}/closed/{n}/*" for n in _names(spark, f"{self.path}/closed")]
        parts = spark.read.parquet(*folders, *closed)
        return parts if len(folders) == 1 and not closed else self.merge(parts)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    return [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
