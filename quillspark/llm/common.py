"""Helpers that the training-data operators share: shared-folder tables, code shipping, slices of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that vectorised code looks at together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_ROOT = Path(__file__).resolve().parents[2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever they run; on one machine they have it already."""
    sc = spark.sparkContext
    if re.fullmatch(r"local(\[.*\])?", sc.master) or getattr(sc, "_quillspark_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in (_ROOT / "quillspark").rglob("*.py"):
            z.write(path, path.relative_to(_ROOT))
    sc.addPyFile(archive)
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder; on one machine (tests) one of our own where neither is set, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_LEFT: dict[str, DataFrame] = {}  # what is still to be deleted, by path


def save(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    drop() deletes it; what a result still reads is deleted when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files of finished jobs
    out = spark.read.schema(schema).parquet(path)
    out._quillspark_path = path
    if not _LEFT:
        atexit.register(_drop_left)
    _LEFT[path] = out
    return out


def _drop_left() -> None:
    for df in [*_LEFT.values()]:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop(df)


def drop(df: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._quillspark_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _LEFT.pop(df._quillspark_path, None)


def with_row(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and `_row` with all of docs' columns, for operators that hand whole rows through."""
    return docs.select(*columns, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with the column `text`: its own, or else that of `_row`, which then crosses to Python once."""
    if "text" in batch.schema.names:
        return batch
    return batch.append_column("text", pc.struct_field(batch.column("_row"), "text"))


#: Parts that the rows of each key are dealt to where few keys may hold most rows.
SALTS = 8


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows with `_salt`, a part by a hash of a column."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def salts() -> Column:
    """An aggregate: the parts of spread() that hold rows of the group, as bits."""
    return F.bit_or(F.expr("shiftleft(1, _salt)"))


def copies(rows: DataFrame) -> DataFrame:
    """Each row once for every `_salt` of its `salts`: the side that meets spread() rows."""
    return rows.withColumn("_salt", F.expr(f"explode(filter(sequence(0, {SALTS - 1}), k -> (salts & shiftleft(1, k)) <> 0))")).drop("salts")


#: Bits of the filter of likely(), 4 MB, and of each of its rows (4 KB, which bitmap_construct_agg() fixes); bits that a key sets in its row.
BITS, BITS_OF_ROW, BITS_OF_KEY = 1 << 25, 1 << 15, 3


def likely(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """The rows whose number is among the keys (of any multiplicity, not null), and those few whose hashes meet other keys'.

    A Bloom filter of fixed size is broadcast, so that no row moves: with two million keys, one other row
    in 200 passes. What follows must bear those; a left semi join for the exact ones does not do, since
    Spark's optimizer moves it below the filter and shuffles all rows.
    """
    key = F.col(by).cast("bigint")
    part = F.pmod(F.xxhash64(key), F.lit(BITS // BITS_OF_ROW)).cast("int").alias("_part")
    marks = [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS_OF_ROW)) for k in range(BITS_OF_KEY)]
    bits = keys.select(part, F.explode(F.array(*marks)).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = lambda at: F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = [F.floor(byte(at) / F.pow(F.lit(2), at % 8)) % 2 == 1 for at in marks]
    near = rows.withColumn("_part", part).join(F.broadcast(bits), "_part")  # 1024 rows at most
    return near.where(reduce(and_, hit)).select(*rows.columns)


#: A key with more than this share of all rows is hot; there are at most so many.
MOST_HOT = 4096


def having_key(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose key is in `keys` (the keys, without nulls, and `n`, their rows among the `total`).

    The keys with more than 1 / MOST_HOT of all rows, of which there are fewer than MOST_HOT,
    are broadcast, so that their rows stay where they are; the others meet by the key.
    """
    hot = F.broadcast(keys.where(F.col("n") * MOST_HOT > total).select(*on, F.lit(True).alias("_hot")))
    marked = rows.join(hot, on, "left")
    rest = marked.where("_hot is null").join(keys.where(F.col("n") * MOST_HOT <= total).select(*on), on, "left_semi")
    return marked.where("_hot").unionByName(rest).select(*rows.columns)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most `most` bytes of text (or one row), each with its UTF-8 bytes and row offsets.

    Null texts count as empty.
    """
    batch = with_text(batch) if column == "text" else batch
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
