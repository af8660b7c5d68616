"""Folders for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below that of spark.checkpoint.dir (or the context's checkpoint folder), which the driver and all executors share; on one machine, where neither is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="quillspark-scratch-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base}/quillspark/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to a scratch folder and read back: what several steps read is made once."""
    path, schema = scratch(rows.sparkSession, name), rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)
