"""Hard-negative mining (operator 11): slot-decomposed selection.

Each anchor has a few positives, its best other rows of the same label.  A positive of score
p admits the negatives whose score lies between a lower and an upper share of p.  The upper
limits of an anchor's positives, in descending order, cut the scores into disjoint slots, and
the windows of all its positives are suffixes of the slots, cut off below.  So a combiner
keeps the k best negatives of each slot and no more: the first k of a window are among the
k best of its slots, whatever the windows share.

Rows are never paired through a shuffle.  Anchors are a stated query set; they are taken in
chunks of about ANCHORS_AT_ONCE, whose vectors are broadcast, and every task scores its own
rows against the chunk in blocks, with k rows for each slot as its whole state.  A chunk takes
two passes: the first finds the positives, the second the negatives.  What a pass leaves is
written to the shared folder.

Edge cases: rows without a label, vector or id, and rows with a component that is null or
not finite, take no part.  Vectors of different lengths are taken as ended by zeros.  Rows
that share an id are rows each: an anchor's other rows are all rows but itself.  Ties go to
the smaller id.  A positive of negative score has no negatives, since its limits are crossed.
Scores beyond 64 bits count as the greatest or the least such number.  Empty tables, and
tables with one label, give an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import drop, save, ship, table

#: Anchors whose vectors are broadcast together.
ANCHORS_AT_ONCE = 16_384
#: Scores that are held at once in a task.
SCORES_AT_ONCE = 1 << 21

_FOUND = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


@dataclass
class Chunk:
    """Anchors by row, label and vector; `upper`: limits of their positives in descending order (a column more for what is below all), or None while positives are sought."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    largest: int
    upper: np.ndarray | None = None

    def slots(self) -> int:
        return 1 if self.upper is None else self.upper.shape[1] - 1

    def part(self, lo: int, hi: int) -> Chunk:
        return Chunk(self.row[lo:hi], self.label[lo:hi], self.vectors[lo:hi], self.largest, None if self.upper is None else self.upper[lo:hi])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, ended by zeros."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _scores(rows: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Inner products, exactly: by floating-point numbers while they hold all sums."""
    largest = max(chunk.largest, 1)
    if rows.shape[1] * largest * largest < 1 << 53:
        return (rows.astype(np.float64) @ chunk.vectors.astype(np.float64).T).astype(np.int64)
    exact = rows.astype(object) @ chunk.vectors.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _first(scores: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the places of the k greatest taken scores, ties by place, and which of them are taken; rows come in order of id."""
    n = len(scores)
    k = min(k, n)
    if max(int(scores.max()), -int(scores.min())) < (1 << 62) // n:
        keys = np.where(taken, scores * n + np.arange(n - 1, -1, -1)[:, None], np.iinfo(np.int64).min)
        places = np.argpartition(keys, n - k, axis=0)[n - k :] if k < n else np.repeat(np.arange(n)[:, None], scores.shape[1], axis=1)
    else:
        places = np.lexsort((np.broadcast_to(np.arange(n)[:, None], scores.shape), ~scores, ~taken), axis=0)[:k]
    return places, np.take_along_axis(taken, places, axis=0)


class _Best:
    """The k best rows of each anchor and slot so far."""

    def __init__(self, anchors: int, slots: int, k: int) -> None:
        self.k = k
        self.kept = np.zeros((4, anchors, slots, k), np.int64)  # has, score, id, row

    def add(self, lo: int, slot: int, found: np.ndarray) -> None:
        hi = lo + found.shape[1]
        both = np.concatenate([self.kept[:, lo:hi, slot], found], axis=2)
        order = np.lexsort((both[3], both[2], ~both[1], -both[0]), axis=-1)[:, : self.k]
        self.kept[:, lo:hi, slot] = np.take_along_axis(both, np.broadcast_to(order, (4, *order.shape)), axis=2)


def _combiner(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part: scores its rows against the chunk, block by block, and gives the k best of each anchor and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk = shared.value
        best = _Best(len(chunk.row), chunk.slots(), k)
        for whole in batches:
            ids_of_all, rows_of_all = (np.asarray(whole.column(c), np.int64) for c in ("vec_id", "row"))
            order = np.lexsort((rows_of_all, ids_of_all))
            batch = whole.take(pa.array(order))
            ids, rows, labels = ids_of_all[order], rows_of_all[order], np.asarray(batch.column("label"), np.int64)
            vectors = _matrix(batch.column("vector"), chunk.vectors.shape[1])
            step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
            for lo in range(0, len(chunk.row) if len(ids) else 0, step):
                part = chunk.part(lo, lo + step)
                scores = _scores(vectors, part)
                like = labels[:, None] == part.label
                for slot in range(part.slots()):
                    if part.upper is None:
                        taken = like & (rows[:, None] != part.row)
                    else:
                        taken = ~like & (scores <= part.upper[:, slot]) & (scores > part.upper[:, slot + 1])
                    if taken.any():
                        places, has = _first(scores, taken, k)
                        best.add(lo, slot, np.stack([has, np.take_along_axis(scores, places, axis=0), ids[places], rows[places]]).astype(np.int64).transpose(0, 2, 1))
        has, score, ids, rows = best.kept
        anchor, slot, place = np.nonzero(has)
        for lo in range(0, len(anchor), 100_000):
            at = tuple(x[lo : lo + 100_000] for x in (anchor, slot, place))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (chunk.row[at[0]], at[1].astype(np.int32), score[at], ids[at], rows[at])], schema=_FOUND)

    return run


def _scan(rows: DataFrame, chunk: Chunk, k: int, name: str) -> DataFrame:
    """The k best rows of each anchor and slot over all rows, as a written table."""
    shared = rows.sparkSession.sparkContext.broadcast(chunk)
    found = rows.select("vec_id", "label", "vector", "row").mapInArrow(_combiner(shared, k), "anchor_row bigint, slot int, score bigint, vec_id bigint, row bigint")
    place = F.row_number().over(Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    out = save(found.withColumn("place", place).where(F.col("place") <= k), name)
    shared.destroy()
    return out


def _limits(found: pa.Table, anchors: np.ndarray, k: int, least: tuple[int, int], most: tuple[int, int]) -> tuple[np.ndarray, list[tuple]]:
    """Upper limits by anchor, descending, and of each positive: anchor, place among the limits, lower limit, id and score.  Positives whose limits are crossed are left out."""
    at = {int(r): i for i, r in enumerate(anchors)}
    upper = np.full((len(anchors), k + 1), np.iinfo(np.int64).min)
    lowest = np.full(len(anchors), np.iinfo(np.int64).max)
    positives, places = [], np.zeros(len(anchors), np.int64)
    for row, score, vec_id in sorted(zip(*(found.column(c).to_pylist() for c in ("anchor_row", "score", "vec_id")), strict=True), key=lambda x: (x[0], -x[1], x[2])):
        low, high = -(-least[0] * score // least[1]), most[0] * score // most[1]
        if low <= high:
            i = at[row]
            upper[i, places[i]], lowest[i] = high, min(lowest[i], low)
            positives.append((row, int(places[i]), low, vec_id, score))
            places[i] += 1
    for i, n in enumerate(places):
        upper[i, n:] = lowest[i] - 1 if n else np.iinfo(np.int64).min  # slots below the last limit are empty
    return upper, positives


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of vec_id, label and vector (integers).

    An anchor's positives are its first `positives` other rows of its label; a positive's
    negatives the first `negatives` rows of other labels whose score is between the shares
    `least` and `most` (numerator, denominator) of its own.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.where("vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    rows = save(whole.select(*(F.col(c).cast("bigint").alias(c) for c in ("vec_id", "label")), F.col("vector").cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")), "vectors")
    size = rows.agg(F.max(F.size("vector")).alias("dims"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("largest"), F.count_if("anchor").alias("anchors")).first()
    chunks = -(-size.anchors // ANCHORS_AT_ONCE)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    done = [spark.createDataFrame([], schema)]
    for c in range(chunks):
        own = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).select("row", "vec_id", "label", "vector").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        chunk = Chunk(*(np.asarray(own.column(x), np.int64) for x in ("row", "label")), _matrix(own.column("vector").chunk(0), size.dims), int(size.largest or 0))
        near = _scan(rows, chunk, positives, "positives")
        chunk.upper, limits = _limits(near.toArrow(), chunk.row, positives, least, most)
        drop(near)
        if not limits:
            continue
        far = _scan(rows, chunk, negatives, "slots")
        names = dict(zip(chunk.row.tolist(), own.column("vec_id").to_pylist(), strict=True))
        windows = spark.createDataFrame([(names[x[0]], *x) for x in limits], "anchor_id bigint, anchor_row bigint, top int, low bigint, positive_id bigint, positive_score bigint")
        # a window is the slots from its own limit down, as far as its lower limit
        met = windows.join(far, "anchor_row").where("slot >= top and score >= low")
        rank = F.row_number().over(Window.partitionBy("anchor_row", "top").orderBy(F.desc("score"), "vec_id", "row"))
        done.append(save(met.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        drop(far)
    drop(rows)
    return reduce(DataFrame.unionByName, done)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; a seventh of the labels are first moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    vector = F.transform("embedding", lambda x: F.floor(256.0 * x.cast("double")))
    return hard_negatives(rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector")), F.expr("vec_id % 100 = 0"))


OP11_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, row_number() over (order by vec_id) as row,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.row as anchor_row, b.vec_id, b.row, a.label = b.label as alike, a.row = b.row as itself,
    cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from v a cross join v b where a.vec_id % 100 = 0),
p as (select anchor_id, anchor_row, vec_id as positive_id, row as positive_row, score as positive_score from s where alike and not itself
  qualify row_number() over (partition by anchor_row order by score desc, vec_id, row) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on p.anchor_row = s.anchor_row and not s.alike and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_row, p.positive_row order by s.score desc, s.vec_id, s.row)
qualify row_number() over w <= 10
"""
