"""Splits, shards, repeats, padding, mixing and batches of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[Column], name: str = "position", width: int = 4096) -> DataFrame:
    """Rows with their place (from 0) in the order of a hash: places within ranges of the hash, and the ranges' counts before, so that no task sorts all rows.

    order[0] is an MD5 in hexadecimal digits; the others break ties.
    """
    live = rows.withColumn("_block", (F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int") * F.lit(width) / 65536).cast("int"))
    counts = live.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", F.expr("sum(_n) over (order by _block) - _n").alias("_before"))  # at most `width` rows
    inner = F.row_number().over(W.partitionBy("_block").orderBy(*order)) - 1
    return live.withColumn("_inner", inner).join(F.broadcast(before), "_block").withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_block", "_inner", "_before")


def by_blocks(rows: DataFrame, lead: str, then: list[str], name: str, blocks: int = 1024) -> DataFrame:
    """Rows with their place (from 0) in the order of a number and further columns: places within ranges of equal size of the number, and the ranges' counts before.

    The ranges come from approximate quantiles, so that no range holds much more than its share
    of the rows, whatever the numbers are; null comes first.  Count and quantiles take one pass.
    """
    shares = [i / blocks for i in range(1, blocks)]
    number = F.col(lead)
    known = F.when(~F.isnan(number.cast("double")), number)
    n, found = rows.agg(F.count("*"), F.percentile_approx(known, shares, 4 * blocks)).first()
    parts = max(1, min(blocks, n // 10_000))
    edges = sorted({found[blocks * i // parts - 1] for i in range(1, parts)}) if found else []
    live = rows.withColumn("_block", _bisect(F.col(lead), edges, 0, len(edges)))
    counts = live.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", F.expr("sum(_n) over (order by _block) - _n").alias("_before"))  # at most `blocks` rows
    inner = F.row_number().over(W.partitionBy("_block").orderBy(F.col(lead).asc_nulls_first(), *then)) - 1
    return live.withColumn("_inner", inner).join(F.broadcast(before), "_block").withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_block", "_inner", "_before")


def _bisect(value: Column, edges: list[float], lo: int, hi: int) -> Column:
    """How many of the sorted edges are less than the value (null: lo), as a tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value > edges[mid], _bisect(value, edges, mid + 1, hi)).otherwise(_bisect(value, edges, lo, mid))


def train_val(rows: DataFrame, ratio: float, order: list[Column]) -> DataFrame:
    """part = val for max(1, int(n * ratio)) rows in a hash order, else train; a ratio of 0 or 1 puts all in one part."""
    if ratio <= 0 or ratio >= 1:
        return rows.withColumn("part", F.lit("train" if ratio <= 0 else "val"))
    most = max(1, int(rows.count() * ratio))
    return numbered(rows, order, "_p").withColumn("part", F.when(F.col("_p") < most, "val").otherwise("train")).drop("_p")


def chunk(position: Column, n: int, parts: int) -> Column:
    """The part (from 0) of a place among n, in contiguous parts of which the first n % parts have one more."""
    size, extra = divmod(n, parts)
    edge = extra * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - edge) / max(1, size))).cast("bigint")


def repeat_to(rows: DataFrame, n: int, target: int, order: list[Column]) -> DataFrame:
    """Every row target // n times, and the first target % n in a hash order once more, with a copy number."""
    whole, rest = divmod(target, n)
    times = F.lit(whole) + F.when(F.col("_p") < rest, 1).otherwise(0)
    return numbered(rows, order, "_p").withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).drop("_p")


def pad_to_divisor(rows: DataFrame, position: str, n: int, divisor: int) -> DataFrame:
    """The first rows once more at the end, until the count divides; padding is flagged."""
    missing = -n % divisor
    return rows.withColumn("padding", F.lit(False)).unionByName(rows.where(F.col(position) < missing).withColumns({position: F.col(position) + n, "padding": F.lit(True)}))


def align(tables: list[DataFrame]) -> DataFrame:
    """One table of all, columns by name, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_checked(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The columns of two tables side by side; the job fails if a key of one is not in the other or occurs twice, or if a column of both has unequal values."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in b.columns if c != key))
    twice = "count(*) over (partition by {k}) > 1"
    a, other = a.withColumn("_twice_a", F.expr(twice.format(k=key))), other.withColumn("_twice_b", F.expr(twice.format(k="_key")))
    both = a.join(other, a[key] == other["_key"], "full")
    bad = F.col(key).isNull() | F.col("_key").isNull() | F.coalesce("_twice_a", F.lit(True)) | F.coalesce("_twice_b", F.lit(True))
    for c in shared:
        bad |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    checked = both.where(F.when(bad, F.raise_error(F.lit("tables of unequal keys or values")).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*(c for c in a.columns if c != "_twice_a"), *(F.col(f"_{c}").alias(c) for c in b.columns if c != key and c not in shared))


def snake(position: Column, parts: int) -> Column:
    """The part of a place when parts are dealt to and fro, which balances sorted sizes."""
    lap, step = F.floor(position / parts), position % parts
    return F.when(lap % 2 == 0, step).otherwise(parts - 1 - step).cast("bigint")
