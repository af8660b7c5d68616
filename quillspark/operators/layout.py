"""Places of rows and of their items: permutations, repeats and folds, and the way between padded rows and one flat row of items.

Places come from blocks of the order (by_blocks), and offsets from the blocks' sums and running
sums within them, so that no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.sampling import by_blocks

#: Items that meet in one task when items look for the row that they lie in.
BLOCK = 4096


def placed(rows: DataFrame, lead: str, then: list[str], name: str = "place") -> DataFrame:
    """Rows with their place in the order of a number and further columns; keys may have gaps."""
    return by_blocks(rows, lead, then, name)


def repeated(rows: DataFrame, times: int, place: str = "place") -> DataFrame:
    """Each row `times` times, with copy, and its places when copies stand together (interleaved) and when the whole recurs (tiled)."""
    n = rows.count()
    each = rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(times)))))
    return each.withColumns({"interleaved": F.col(place) * times + F.col("copy"), "tiled": F.col("copy") * F.lit(n) + F.col(place)})


def folded(rows: DataFrame, width: int, place: str = "place") -> DataFrame:
    """Rows with the row and the column of their place in rows of a width."""
    return rows.withColumns({"row": part(F.col(place), width), "column": F.col(place) % width})


def part(place: Column, size: int) -> Column:
    """The part of a place when parts have `size` rows."""
    return F.floor(place / size).cast("bigint")


def offsets(rows: DataFrame, length: str, place: str = "place") -> DataFrame:
    """Rows with start and end: where their items lie when all rows' items stand in one row, in the order of place."""
    live = rows.withColumn("_block", part(F.col(place), BLOCK))
    sums = live.groupBy("_block").agg(F.sum(length).alias("_sum"))
    # blocks of blocks, so that the running sum over blocks is not one long window
    high = sums.withColumn("_high", part(F.col("_block"), BLOCK))
    tops = high.groupBy("_high").agg(F.sum("_sum").alias("_t")).select("_high", F.expr("sum(_t) over (order by _high) - _t").alias("_base"))  # a row for each 16 million rows
    before = high.withColumn("_in", F.sum("_sum").over(W.partitionBy("_high").orderBy("_block")) - F.col("_sum")).join(F.broadcast(tops), "_high").select("_block", (F.col("_base") + F.col("_in")).alias("_before"))
    inner = F.sum(length).over(W.partitionBy("_block").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    out = live.withColumn("_upto", inner).join(before, "_block")
    return out.withColumn("end", (F.col("_before") + F.col("_upto")).cast("bigint")).withColumn("start", (F.col("end") - F.col(length)).cast("bigint")).drop("_block", "_before", "_upto")


def flat(rows: DataFrame, values: str) -> DataFrame:
    """at, value: the items of all rows in one row; rows: start and a list."""
    return rows.select("start", F.posexplode(values).alias("_i", "value")).select((F.col("start") + F.col("_i")).alias("at"), "value")


def padded(items: DataFrame, rows: DataFrame, width: int, pad: Column, left: bool = True) -> DataFrame:
    """The rows with `values`, their items of the flat row, and `mask`, which is 1 where an item stands: `width` long, and padded before the items (or, not left, behind them).

    items: at, value.  rows: start, end and a `place` of their own.  Items and rows meet by the blocks of the flat
    row that a row touches.  Of a row longer than the width the last items stay (or, not left, the first).
    """
    spans = rows.select("place", "start", "end").where("end > start").withColumn("_block", F.explode(F.sequence(part(F.col("start"), BLOCK), part(F.col("end") - 1, BLOCK))))
    met = items.withColumn("_block", part(F.col("at"), BLOCK)).join(spans, "_block").where("at >= start and at < end")
    kept = met.where(F.col("at") >= F.col("end") - width if left else F.col("at") < F.col("start") + width)
    lists = kept.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_l")).select("place", F.col("_l.value").alias("_v"))  # at most `width` long
    out = rows.join(lists, "place", "left")
    have = F.coalesce(F.col("_v"), F.array().cast(f"array<{items.schema['value'].dataType.simpleString()}>"))
    missing = F.lit(width) - F.size(have)
    fill, none, some = F.array_repeat(pad, missing), F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(have))
    both = (F.concat(fill, have), F.concat(none, some)) if left else (F.concat(have, fill), F.concat(some, none))
    return out.withColumns({"values": both[0], "mask": both[1]}).drop("_v")


def unpadded(rows: DataFrame, values: str, mask: str) -> DataFrame:
    """Rows with the items of a list where the mask is 1, as `items`."""
    pairs = F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1)
    return rows.withColumn("items", F.transform(pairs, lambda x: x["v"]))
