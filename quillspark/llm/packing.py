"""Best-fit packing of token sequences (operator 3) with Martello-Toth dominance reduction.

The packing is planned on the histogram of piece lengths, which has at most `capacity`
entries however many documents there are:

1. Reduction.  A set of pieces that provably dominates every other set with one of its
   pieces is fixed for good and leaves the instance: some best packing has it.  A pair that
   fills a sequence exactly dominates all; so does a piece alone beside which nothing fits;
   so does a piece with the longest that fits beside it, where no two others use more room
   and no three fit; and so does a piece with that longest and a third that fills the
   sequence, where no three fit and at most one piece lies between the two.  Lengths are
   tried from the longest down, past those of which nothing is proved.  Copies of a set are
   fixed together, so that each step removes a length.
2. Best fit, longest first, on what is left: each piece goes to the fullest open sequence
   that takes it; again, equal sequences are handled together.

The plan is a table of slots (length, first rank, sequences, places).  Pieces get their
ranks within a length by salted buckets, so that a length that a third of all rows have is
spread over many tasks, and look their place up in the broadcast plan, whose size is
bounded by the capacity.

Edge cases: null text is empty, and an empty document is one end-of-text id; a document
longer than the capacity is cut into full pieces and a shorter last one; repeated rows and
ties in doc_id are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.bpe import loaded, vocabulary
from quillspark.llm.common import save, ship, table

#: Pieces that one task ranks.
BUCKET_ROWS = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Plan:
    """Slots of a packing: which ranks of a length lie in which sequences, and where."""

    def __init__(self) -> None:
        self.slots: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, count, first sequence, copies in each, offset
        self.used: dict[int, int] = {}
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, copies: int, offset: int) -> None:
        """`count` pieces of one length, `copies` in each sequence from `sequence` on, the first at `offset`."""
        rank = self.used.get(length, 0)
        self.slots.append((length, rank, count, sequence, copies, offset))
        self.used[length] = rank + count

    def fix(self, lengths: list[int], times: int) -> None:
        """`times` new sequences, each with pieces of these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, times, self.sequences, 1, offset)
            offset += length
        self.sequences += times


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, copies in each, offset) for every piece of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] += count
    plan = _Plan()
    _reduce(left, capacity, plan)
    _best_fit(left, capacity, plan)
    return plan.slots


def _reduce(left: np.ndarray, capacity: int, plan: _Plan) -> None:
    """Fix dominating sets; what remains stays in `left`."""
    if left[capacity]:
        plan.fix([capacity], int(left[capacity]))
        left[capacity] = 0
    for long in range(capacity - 1, capacity // 2, -1):
        if times := int(min(left[long], left[capacity - long])):
            plan.fix([long, capacity - long], times)
            left[long] -= times
            left[capacity - long] -= times
    if capacity % 2 == 0 and (times := int(left[capacity // 2] // 2)):
        plan.fix([capacity // 2] * 2, times)
        left[capacity // 2] -= 2 * times
    long = capacity
    while long > 0:
        if not left[long] or not _fix_with(left, long, capacity, plan):
            long -= 1  # nothing is proved of it: on to the next


def _fix_with(left: np.ndarray, long: int, capacity: int, plan: _Plan) -> bool:
    """Fix the dominating set with a piece of this length, as often as it occurs, if there is one of up to three pieces."""
    room = capacity - long
    fits = np.flatnonzero(left[: room + 1])
    if left[long] == 1:
        fits = fits[fits != long]
    if len(fits) == 0:
        times = int(left[long])
        plan.fix([long], times)
        left[long] -= times
        return True
    beside, least = int(fits[-1]), int(fits[0])
    three = 3 * least <= room  # three more might fit
    if beside == room or not three and _best_pair(left, fits, long, room) <= beside:
        times = int(left[long] // 2 if beside == long else min(left[long], left[beside]))
        if 2 * long + beside <= capacity:
            times = min(times, 1)  # copies of this length could meet in one sequence
        plan.fix([long, beside], times)
        left[long] -= times
        left[beside] -= times
        return True
    third = room - beside
    if three or long <= room or third > beside or third == beside and left[beside] < 2 or not left[third] or left[third + 1 : beside].sum() > 1:
        return False
    times = int(min(left[long], left[beside] // 2 if third == beside else left[beside], left[third]))
    plan.fix([long, beside, third], times)
    for length in (long, beside, third):
        left[length] -= times
    return True


def _best_pair(left: np.ndarray, fits: np.ndarray, long: int, room: int) -> int:
    """The most room that two of the pieces that fit can use; 0 if no two fit."""
    at = np.searchsorted(fits, room - fits, side="right") - 1
    # a length that one piece has goes with a shorter one, not with itself
    own = (at >= 0) & (fits[np.maximum(at, 0)] == fits) & (left[fits] - (fits == long) < 2)
    at = np.where(own, at - 1, at)
    sums = np.where(at >= 0, fits + fits[np.maximum(at, 0)], 0)
    return int(sums.max())


def _best_fit(left: np.ndarray, capacity: int, plan: _Plan) -> None:
    """Best fit, longest first; groups of equal open sequences by the room they have."""
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, number)
    rooms = np.zeros(capacity + 1, bool)

    def give(room: int, sequence: int, number: int) -> None:
        if room > 0 and number > 0:
            open_.setdefault(room, []).append((sequence, number))
            rooms[room] = True

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            ready = np.flatnonzero(rooms[length:])
            if len(ready) == 0:
                each = capacity // length
                number = count // each
                if number:
                    plan.put(length, number * each, plan.sequences, each, 0)
                    give(capacity - each * length, plan.sequences, number)
                    plan.sequences += number
                if rest := count - number * each:
                    plan.put(length, rest, plan.sequences, rest, 0)
                    give(capacity - rest * length, plan.sequences, 1)
                    plan.sequences += 1
                count = 0
                break
            room = int(ready[0]) + length
            sequence, number = open_[room].pop()
            if not open_[room]:
                rooms[room] = False
            each = room // length
            whole = min(number, count // each)
            if whole:
                plan.put(length, whole * each, sequence, each, capacity - room)
                give(room - whole_room(each, length), sequence, whole)
                count -= whole * each
            if number > whole:
                if count and count < each:
                    plan.put(length, count, sequence + whole, count, capacity - room)
                    give(room - count * length, sequence + whole, 1)
                    whole, count = whole + 1, 0
                give(room, sequence + whole, number - whole)
        left[length] = 0


def whole_room(each: int, length: int) -> int:
    """Room that `each` pieces take."""
    return each * length


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces of every document's ids with the end id appended, with a checksum of each."""
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    cut = save(pieces(docs, capacity, end_id, path), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = sorted(plan_packing(histogram, capacity))
    columns = [np.array(c, np.int64) for c in zip(*slots, strict=True)] if slots else [np.zeros(0, np.int64)] * 6
    plan = spark.sparkContext.broadcast(columns)
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    salted = cut.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {buckets}) as int)"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", F.expr("sum(n) over (partition by length order by bucket) - n").alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    top = 1 << 40  # ranks of one length lie between multiples of it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, copies, offset = plan.value
        keys = length * top + first
        for batch in batches:
            own, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, own * top + rank, side="right") - 1
            local = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + local // copies[at]), pa.array(offset[at] + local % copies[at] * own)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint").alias("rank"))
    return out.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
