"""Row counters that ride along with a job, batch or stream."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame and the count of its rows, readable after an action: ``observation.get[name]``."""
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias(name)), observation


class StreamCounters(StreamingQueryListener):
    """What streams observe: the first metric of each named observation, by query, observation and trigger.

    A trigger that runs again after a failure replaces its own count.  As a context it listens from start to end.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._counts: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> StreamCounters:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self._counts[str(event.progress.id), name][event.progress.batchId] = row[0]

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.id)].set()

    def totals(self, query: StreamingQuery, patience: float = 60) -> dict[str, int]:
        """Sums over the triggers of a query that has ended; its last report may come a little later."""
        if not self._ended[str(query.id)].wait(patience):
            raise TimeoutError("the query has not reported its end")
        return {name: sum(by.values()) for (who, name), by in self._counts.items() if who == str(query.id)}
