"""Counters of running streams, and streams in bounded pieces."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = "query string, batch bigint, at string, input_rows bigint, rows_per_second double, state_rows bigint, done bigint, error string"


class Progress(StreamingQueryListener):
    """Keeps a row for each micro-batch of the queries of a name (None: of all): how many rows came in, how many state rows there are, and how many rows are done so far; the last `most` of them.

    An end with an error is a row too.  spark.streams.addListener() makes it listen.
    """

    def __init__(self, name: str | None = None, most: int = 10_000) -> None:
        self.name, self.rows, self.done = name, deque(maxlen=most), {}
        self.ids: dict[str, str] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.ids[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query = p.name or str(p.id)
        if self.name is not None and query != self.name:
            return
        with self.lock:
            self.done[query] = self.done.get(query, 0) + p.numInputRows
            state = sum(s.numRowsTotal for s in p.stateOperators)
            self.rows.append((query, p.batchId, p.timestamp, p.numInputRows, p.processedRowsPerSecond, state, self.done[query], None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        query = self.ids.get(str(event.id), str(event.id))
        if event.exception and (self.name is None or query == self.name):
            with self.lock:
                self.rows.append((query, None, None, None, None, None, self.done.get(query, 0), event.exception.splitlines()[0]))

    def table(self, spark: SparkSession) -> DataFrame:
        """The counters so far."""
        with self.lock:
            return spark.createDataFrame([*self.rows], COUNTERS)


def bounded(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files of which a micro-batch takes at most so many."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
