"""Quality classifier (operator 7): nearest-neighbour voting among latent-semantic vectors.

Terms are hashed pairs of bytes, which catch casing, symbols and letter sequences, and marks
of how far a text repeats its own words and windows and how short it is.  Term weights are
1 + log(tf) times idf.  A singular value decomposition of a bounded sample of about
`SAMPLE_ROWS` labelled documents gives the latent space (subspace iteration, block by block,
so that the driver holds the sample once, as half-precision terms, and nothing as large
besides); the sample's vectors there, unit length, are broadcast (`SAMPLE_ROWS` x
`DIMENSIONS` floats).  Every document's cosine with each of them is computed exactly, a
block of documents at a time, and its nearest neighbours vote with a power of the similarity.

Edge cases: null and empty texts have only the marks of an empty text, and a score like any
other; very long texts are counted whole, in time linear in their length; of neighbours at
equal cosine about the last place any may vote, and equal texts get equal scores; without
labelled rows every score is 1; rows that share a doc_id are scored each, by their own text;
repeated rows are scored each; a null doc_id is scored but teaches nothing; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words
from quillspark.llm.common import ship, slices, table, with_row

SAMPLE_ROWS, DIMENSIONS, NEIGHBOURS, POWER = 4000, 32, 15, 8
TERMS = 2048
MARKS = 24  # share of repeated words, share of repeated windows of four words, 1 / number of words: eight grades each
SWEEPS = 40  # of the subspace iteration
BLOCK = 256  # rows that dense vectors are made of at a time
MARK_WEIGHT = 0.6  # of a text's length as a vector


def term_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 + log of each hashed byte pair's count, and the marks, of each row."""
    n = len(offsets) - 1
    starts, ends, first = words.spans(data, offsets)
    fp = words.fingerprints(data, starts, ends)
    out = np.zeros((n, TERMS), np.float32)
    pair = (data[:-1].astype(np.uint32) << 8 | data[1:]) if len(data) > 1 else np.zeros(0, np.uint32)
    pair = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)  # 11 bits
    marks = np.zeros((n, MARKS), np.float32)
    eight = words.windows(fp, 4)
    for i in range(n):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        if hi - lo > 1:
            counted = np.bincount(pair[lo : hi - 1], minlength=TERMS)
            some = counted > 0
            out[i, some] = 1 + np.log(counted[some])
        a, b = int(first[i]), int(first[i + 1])
        size = b - a
        shares = [0.0, 0.0, 0.0]
        if size:
            shares[0] = 1 - len(np.unique(fp[a:b])) / size
            if size >= 8:
                shares[1] = 1 - len(np.unique(eight[a : b - 3])) / (size - 3)
            shares[2] = 1 / size
        for k, share in enumerate(shares):
            marks[i, 8 * k + min(7, int(share * 8))] = 1
    return out, marks


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    @staticmethod
    def unit(weights: np.ndarray, marks: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Vectors in term space."""
        w = weights * idf
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        return np.hstack([w, MARK_WEIGHT * marks])

    @staticmethod
    def fit(terms: np.ndarray, labels: np.ndarray) -> Model:
        """From the sample's term weights and marks (one row each, in half precision) and labels."""
        n = len(terms)
        blocks = [terms[lo : lo + BLOCK] for lo in range(0, n, BLOCK)]
        seen = sum(((b[:, :TERMS] > 0).sum(0) for b in blocks), np.zeros(TERMS, np.int64))
        idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1

        def units() -> Iterator[np.ndarray]:
            for b in blocks:
                b = b.astype(np.float32)
                yield Model.unit(b[:, :TERMS], b[:, TERMS:], idf)

        basis = _top_space(units, TERMS + MARKS, DIMENSIONS).astype(np.float32)
        return Model(idf, basis, np.vstack([Model._latent(x, basis) for x in units()]), labels.astype(np.float32))

    @staticmethod
    def _latent(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        z = x @ basis
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, weights: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Share of label 1 in the neighbours' votes."""
        out = []
        for lo in range(0, len(weights), 256):
            z = self._latent(self.unit(weights[lo : lo + 256], marks[lo : lo + 256], self.idf), self.basis)
            close = z @ self.vectors.T
            k = min(NEIGHBOURS, close.shape[1])
            near = np.argpartition(-close, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(close, near, 1), 1e-3) ** POWER
            out.append((vote * self.labels[near]).sum(1) / vote.sum(1))
        return np.clip(np.concatenate(out), 0, 1).astype(np.float64) if out else np.zeros(0)


def _top_space(blocks: Callable[[], Iterator[np.ndarray]], width: int, k: int) -> np.ndarray:
    """The k right singular vectors of greatest singular value of a matrix that comes in blocks of rows: subspace iteration with some vectors to spare."""
    spare = min(width, k + 16)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((width, spare)))[0]
    for _ in range(SWEEPS):
        y = np.zeros((width, spare))
        for x in blocks():
            y += x.T @ (x @ q.astype(np.float32))
        q = np.linalg.qr(y)[0]
    small = np.zeros((spare, spare))
    for x in blocks():
        z = x @ q.astype(np.float32)
        small += z.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh(small)
    return q @ vectors[:, np.argsort(-values)[:k]]


def fit(docs: DataFrame, labels: DataFrame, learnable: str = "true", rows: int = SAMPLE_ROWS) -> Model | None:
    """From about `rows` labelled documents that the condition on doc_id allows, chosen by a hash of doc_id."""
    ship(docs.sparkSession)
    own = labels.where(f"doc_id is not null and quality is not null and ({learnable})").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = own.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    picked = F.broadcast(own.withColumn("_order", order).where(F.col("_order") < min(1.0, rows / max(1, n))).limit(2 * rows))  # its size is bounded by `rows`
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).join(picked, "doc_id").select("quality", "text", "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                weights, marks = term_weights(data, offsets)
                both = np.hstack([weights, marks]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("_order"), pa.array([r.tobytes() for r in both], pa.binary())], ["quality", "_order", "terms"])

    kind = own.schema["quality"].dataType.simpleString()
    got = sample.mapInArrow(run, f"quality {kind}, _order double, terms binary").orderBy("_order", "terms").limit(rows + rows // 4).collect()
    if not got:
        return None
    x = np.empty((len(got), TERMS + MARKS), np.float16)
    y = np.array([r["quality"] for r in got])
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r["terms"], np.float16)
    del got, r
    return Model.fit(x, y)


def score(docs: DataFrame, model: Model | None, keep_row: bool = False) -> DataFrame:
    """doc_id and score of every document's whole text; with `keep_row` also `_row`, its columns as they came."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.basis, model.vectors, model.labels) if model else None)
    rows = _rows(docs, keep_row)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                scores = own.score(*term_weights(data, offsets)) if own else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores)], [*kept, "score"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))


def _rows(docs: DataFrame, keep_row: bool) -> DataFrame:
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return with_row(docs, own[0]) if keep_row else docs.select(*own)


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    model = fit(docs, table(spark, sf_dir, "labels"), f"not ({held})")
    return score(docs, model).select("doc_id", F.expr(f"coalesce({held}, false)").alias("held_out"), "score", F.expr("cast(score >= 0.3 as int)").alias("predicted"))
