"""Streams: a resumable log of results with the latest row of each key, and token packing with carry-over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.evaluation import latest_per_key


def append_log(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Every batch's rows with its number, as Parquet in a folder for that batch: a batch that runs again overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/n={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str, key: str, seq: str) -> DataFrame:
    """The latest row of each key in the log."""
    rows = spark.read.parquet(log).withColumn("_seq", F.struct("batch", seq))
    return latest_per_key(rows, key, "_seq").drop("_seq", "batch", "n")


def pending(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows whose key the log has no result without an error for."""
    return rows.join(log.where("not error").select(key), key, "left_anti")


PACKED = "shard bigint, pack bigint, ids array<bigint>, length bigint"


def pack_stream(stream: DataFrame, capacity: int, patience_ms: int | None = None) -> DataFrame:
    """Packs of at most `capacity` tokens for each shard, next fit: what doesn't fill one is carried over to the next batch.

    stream: shard, id, length.  The state of a shard is one open pack; a longer row is a pack of
    its own.  A row without an id ends its shard: the open pack comes out, and the next starts anew.
    With `patience_ms` an open pack also comes out once nothing came for so long.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, total, number = state.get if state.exists else ([], 0, 0)
        ids, out, ended = list(ids), [], state.hasTimedOut
        for rows in batches:
            ended |= bool(rows["id"].isna().any())
            rows = rows[rows["id"].notna()]
            for i, n in zip(rows["id"].tolist(), rows["length"].tolist(), strict=True):
                if ids and total + n > capacity:
                    out.append((key[0], number, ids, total))
                    ids, total, number = [], 0, number + 1
                ids.append(int(i))
                total += int(n)
        if ended and ids:
            out.append((key[0], number, ids, total))
            ids, total, number = [], 0, number + 1
        state.update((ids, total, number))
        if patience_ms is not None and ids:
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=["shard", "pack", "ids", "length"])

    return stream.groupBy("shard").applyInPandasWithState(step, PACKED, "ids array<bigint>, total bigint, number bigint", "append", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def ends(rows: DataFrame) -> DataFrame:
    """One row without an id for each shard, to be written behind the last rows of a stream that ends."""
    return rows.select("shard").distinct().select("shard", F.lit(None).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("length"))


def windowed_counts(stream: DataFrame) -> DataFrame:
    """Events of each type in five-minute windows, ten minutes late at most (an extension; the batch form is a query)."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
