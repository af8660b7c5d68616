"""Rows dealt to parts of equal load, budgets of tokens, and batches with a cap on one class.

A greedy assignment needs only how many rows have each length: it is planned on that histogram,
and rows find their part by their rank within their length.  So no task holds all rows, nor
all rows of one length.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.sampling import by_blocks

#: Distinct lengths of a histogram; more are an error, since the plan is made on the driver.
MOST_LENGTHS = 1 << 20

Step = tuple[int, int, int, int, int, int, int]


def greedy_plan(histogram: list[tuple[int, int]], parts: int, equal_size: bool = False) -> list[Step]:
    """Steps (length, from, to, period, low, high, part) of the assignment of the longest rows first, each to a part of least load.

    A row of that length and of rank r, from <= r < to, goes to part + (r - from) % period - low if
    low <= (r - from) % period < high.  Parts of equal loads are one entry of a heap, which takes whole
    laps until it reaches the next one, and once all loads are within a length of each other the
    rest of that length is dealt in whole laps, so that the plan grows with the lengths and not with
    the rows or the longest row.  With equal_size, counts are levelled before loads.
    """
    bias = sum(n * c for n, c in histogram) + 1 if equal_size else 0
    groups: dict[int, list[tuple[int, int]]] = {0: [(0, parts)]}  # load -> ranges of parts
    heap, steps = [0], []

    def put(load: int, ranges: list[tuple[int, int]]) -> None:
        if load not in groups:
            groups[load] = []
            heapq.heappush(heap, load)
        groups[load] = _joined(groups[load] + ranges)

    for n, count in sorted(histogram, reverse=True):
        rank, weight = 0, n + bias
        while rank < count:
            least, left = heap[0], count - rank
            if left >= parts and max(groups) - least <= weight:
                laps, place = left // parts, 0
                for load in sorted(groups):
                    for lo, hi in groups[load]:
                        steps.append((n, rank, rank + laps * parts, parts, place, place + hi - lo, lo))
                        place += hi - lo
                rank += laps * parts
                groups = {load + laps * weight: r for load, r in groups.items()}
                heap = sorted(groups)
                continue
            heapq.heappop(heap)
            taken, kept = _first(groups.pop(least), left)
            place = 0
            for lo, hi in taken:
                place += hi - lo
            total, place = place, 0
            most = left // total
            laps = most if not weight else max(1, min(most, -(-(heap[0] - least) // weight))) if heap else 1
            for lo, hi in taken:
                steps.append((n, rank, rank + laps * total, total, place, place + hi - lo, lo))
                place += hi - lo
            rank += laps * total
            if kept:
                put(least, kept)
            put(least + laps * weight, taken)
    return steps


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _first(ranges: list[tuple[int, int]], n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The first n of the parts, and the others."""
    taken, kept = [], []
    for lo, hi in ranges:
        cut = min(hi, lo + n)
        if cut > lo:
            taken.append((lo, cut))
            n -= cut - lo
        if cut < hi:
            kept.append((cut, hi))
    return taken, kept


def rank_within(rows: DataFrame, by: str, order: str, name: str = "rank") -> DataFrame:
    """Rows with their rank (from 0) within the rows of a value: ranks within hash parts of the order, and the parts' counts before, so that a value that many rows have is ranked by many tasks."""
    salts = max(1, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    live = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    counts = live.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_salt", (F.sum("_n").over(W.partitionBy(by).orderBy("_salt")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(W.partitionBy(by, "_salt").orderBy(order)) - 1
    return live.withColumn("_i", inner).join(before, [by, "_salt"]).withColumn(name, (F.col("_i") + F.col("_before")).cast("bigint")).drop("_salt", "_i", "_before")


def balanced(rows: DataFrame, length: str, order: str, parts: int, equal_size: bool = False) -> DataFrame:
    """Rows with `part` (from 0), dealt longest first to the part of least load; equal_size asks that the parts divide the rows."""
    histogram = rows.groupBy(F.col(length).cast("bigint").alias("n")).agg(F.count("*").alias("c")).limit(MOST_LENGTHS + 1).collect()
    if len(histogram) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths; round them first")
    total = sum(r.c for r in histogram)
    if equal_size and total % parts:
        raise ValueError(f"{total} rows do not divide into {parts} parts")
    steps = greedy_plan([(r.n, r.c) for r in histogram], parts, equal_size)
    spark = rows.sparkSession
    plan = spark.createDataFrame(steps, "_n bigint, _from bigint, _to bigint, _period bigint, _low bigint, _high bigint, _part bigint")
    ranked = rank_within(rows.withColumn("_length", F.col(length).cast("bigint")), "_length", order, "_rank")
    at = (F.col("_rank") - F.col("_from")) % F.col("_period")
    met = ranked.join(F.broadcast(plan), (F.col("_length") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")) & (at >= F.col("_low")) & (at < F.col("_high")))
    return met.withColumn("part", F.col("_part") + at - F.col("_low")).drop("_length", "_rank", *plan.columns)


def budget_batches(rows: DataFrame, length: str, order: str, most: int, strict: bool = True) -> DataFrame:
    """Rows with `batch`: as many balanced batches as their total needs at `most` tokens each (fewer rows than that: one each; no tokens: none, and null), those of the greatest sum of squared lengths first, which is what attention costs; ties by the least order.

    A row longer than a batch is an error; if not strict, it is dealt like the others, and its batch is beyond `most`.
    """
    size = rows.agg(F.count("*").alias("n"), F.sum(length).alias("total"), F.max(length).alias("longest")).first()
    if not size.total:
        return rows.withColumn("batch", F.lit(None).cast("bigint"))
    if strict and size.longest > most:
        raise ValueError(f"a row of {size.longest} is longer than a batch of {most}")
    dealt = balanced(rows, length, order, min(size.n, -(-size.total // most)))
    cost = dealt.groupBy("part").agg(F.sum(F.col(length).cast("double") * F.col(length)).alias("_cost"), F.min(order).alias("_first"))
    places = by_blocks(cost.withColumn("_cost", -F.col("_cost")), "_cost", ["_first"], "batch").select("part", "batch")
    return dealt.join(places, "part").drop("part")


def unbalance(rows: DataFrame, length: str, place: str, part: str, parts: int) -> DataFrame:
    """Least and greatest load of the parts, before (rows in their place, in equal runs) and after, and the mean load."""
    run = F.floor(F.col(place) / F.lit(max(1, rows.count() // parts))).cast("bigint")
    before = rows.groupBy(run.alias("k")).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("_total"))
    after = rows.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return before.crossJoin(after).select("min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max", (F.col("_total") / parts).alias("mean"))


def capped_batch(capped: Column, rank: Column, n_capped: Column, n_other: Column, size: int, most: int) -> Column:
    """The batch of a row by its class, its rank in the class and the sizes of both, where a batch of `size` takes `most` rows of the capped class first, then others, and fills up with what is left.

    While both classes last, batches are alike; the next one takes what one class has left and
    fills up with the other, of which whole batches follow.
    """
    room = size - most
    whole = lambda n, per: F.floor(n / per) if per else F.lit(None).cast("bigint")
    alike = F.least(whole(n_capped, most), whole(n_other, room))  # null is passed over
    left_c, left_o = n_capped - alike * most, n_other - alike * room
    first_c = F.least(F.lit(most), left_c)
    first_o = F.least(size - first_c, left_o)
    mixed_c = first_c + F.least(size - first_c - first_o, left_c - first_c)
    mixed_o = first_o + F.least(size - mixed_c - first_o, left_o - first_o)

    def batch(per: int, mixed: Column) -> Column:
        beyond = rank - alike * per
        early = F.floor(rank / per) if per else F.lit(None).cast("bigint")
        return F.when(beyond < 0, early).when(beyond < mixed, alike).otherwise(alike + 1 + F.floor((beyond - mixed) / size))

    return F.when(capped, batch(most, mixed_c)).otherwise(batch(room, mixed_o)).cast("bigint")


def capped_batches(rows: DataFrame, capped: str, key: str, size: int, ratio: float, seed: str = "0") -> DataFrame:
    """Rows with `batch` and `place`: shuffled, in batches of `size` of which at most the ratio is of the capped class while others last."""
    from quillspark.operators.sampling import numbered
    from quillspark.operators.supervision import hash_order

    most = max(0, min(size, int(size * ratio)))
    live = rows.withColumn("_c", F.coalesce(F.col(capped), F.lit(False)))
    counts = live.agg(F.count_if("_c").alias("c"), F.count_if(~F.col("_c")).alias("o")).first()
    order = [hash_order(seed, key), F.col(key)]
    ranked = numbered(live.where("_c"), order, "_rank").unionByName(numbered(live.where("not _c"), order, "_rank"))
    out = ranked.withColumn("batch", capped_batch(F.col("_c"), F.col("_rank"), F.lit(counts.c), F.lit(counts.o), size, most))
    place = F.row_number().over(W.partitionBy("batch").orderBy(hash_order(f"{seed}:place", key), key)) - 1  # a batch is `size` rows
    return out.withColumn("place", place.cast("bigint")).drop("_c", "_rank")


def capped_stats(batches: DataFrame, capped: str, size: int, ratio: float) -> DataFrame:
    """How many batches there are, the greatest share of the capped class in one, and how many full ones are above the ratio."""
    each = batches.groupBy("batch").agg(F.count("*").alias("n"), F.avg(F.when(F.col(capped), 1.0).otherwise(0.0)).alias("share"))
    return each.agg(F.count("*").alias("num_batches"), F.coalesce(F.max("share"), F.lit(0.0)).alias("max_observed_ratio"), F.count_if((F.col("n") == size) & (F.col("share") > ratio)).alias("overflow_full_batches"))
