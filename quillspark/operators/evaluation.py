"""Evaluation of candidates, predictions, costs and training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key; as an aggregate, so that a hot key is combined before the shuffle."""
    value = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(value, F.col(seq)).alias("_row")).select("_row.*")


def moving_average(rows: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """Mean of the last `width` rows (at most as many as there are); series of fewer than three rows stay as they are."""
    n = F.count("*").over(W.partitionBy(by))
    frame = F.avg(value).over(W.partitionBy(by).orderBy(order).rowsBetween(1 - width, 0))
    return rows.withColumn("smoothed", F.when((n < 3) | F.lit(width <= 1), F.col(value)).otherwise(frame))


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """by, n, and for each name the value at a rank (from 0) within the group; ranks between two places are interpolated.

    ranks: SQL over n, the number of values.  Exact, though no group is sorted or held whole:
    approximate quantiles bound each rank from either side, values below are counted, and only
    the hundredth part of a group that lies between is put in order.  Groups of fewer than
    2000 values are ordered whole.
    """
    live = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sizes = live.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*(F.lit(i / 200) for i in range(201))), 10_000).alias("_q"))
    wanted = sizes.select(*by, "n", "_q", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.expr(f"cast({sql} as double)").alias("rank")) for name, sql in ranks.items()))).alias("w"))
    at = F.floor(F.col("w.rank") / F.col("n") * 200).cast("int")  # of the 200 parts; one more on either side covers the error of the quantiles
    wanted = wanted.select(*by, "n", "w.name", "w.rank", F.when(F.col("n") >= 2000, F.get("_q", F.greatest(at - 1, F.lit(0)))).alias("lo"), F.when(F.col("n") >= 2000, F.get("_q", F.least(at + 2, F.lit(200)))).alias("hi"))
    key = F.col("lo").isNull()
    bounds = wanted.groupBy(*by).agg(F.collect_list(F.struct("name", "lo", "hi")).alias("_b"))  # as many as there are ranks
    each = live.join(bounds, by).select(*by, "_v", F.inline("_b")).where(key | (F.col("_v") <= F.col("hi")))
    inside = key | (F.col("_v") >= F.col("lo"))
    counted = each.groupBy(*by, "name", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))  # what lies below is one row, of null
    upto = F.sum("_c").over(W.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first()))
    ordered = counted.withColumn("_upto", upto).join(wanted.select(*by, "n", "name", "rank"), [*by, "name"])
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    low, high = F.floor("rank"), F.ceil("rank")
    found = ordered.groupBy(*by, "n", "name").agg(F.max(F.when(holds(low), F.col("_v"))).alias("a"), F.max(F.when(holds(high), F.col("_v"))).alias("b"), F.max(F.col("rank") - low).alias("f"))
    found = found.withColumn("_x", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return found.groupBy(*by, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in ranks))


def average_ranks(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows with r: the rank (from 1) of the value within the group, equal values sharing the mean of theirs.

    Equal values are counted first; their ranks are running counts within 256 ranges of a group,
    whose edges are approximate quantiles, and over the ranges' counts.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    edges = counts.groupBy(by).agg(F.percentile_approx(value, F.array(*(F.lit(i / 256) for i in range(1, 256))), 2560).alias("_q"))
    block = F.aggregate("_q", F.lit(0), lambda a, q: a + F.when(F.col(value) > q, 1).otherwise(0))
    live = counts.join(edges, by).select(by, value, "_n", block.alias("_b"))
    totals = live.groupBy(by, "_b").agg(F.sum("_n").alias("_t"))
    before = totals.select(by, "_b", (F.sum("_t").over(W.partitionBy(by).orderBy("_b")) - F.col("_t")).alias("_before"))  # at most 256 rows a group
    inner = F.sum("_n").over(W.partitionBy(by, "_b").orderBy(value)) - F.col("_n")
    ranks = live.withColumn("_i", inner).join(before, [by, "_b"]).select(by, value, (F.col("_before") + F.col("_i") + (F.col("_n") + 1) / 2.0).alias("r"))
    return rows.join(ranks, [by, value])


def numeric_summary(rows: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """by, and the sum, mean, exact percentiles by linear interpolation, and max of each group; 0 where there is no value."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_sum"), F.avg(value).alias("_mean"), F.max(value).alias("_max"))
    ranks = order_statistics(rows, by, value, {f"p{p}": f"(n - 1) * {p / 100}" for p in (50, 90, 95, 99)})
    same = F.lit(True)
    for c in by:
        same &= sums[c].eqNullSafe(ranks[c])
    out = sums.join(ranks, same, "left")
    return out.select(*(sums[c] for c in by), *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"{prefix}_{n}") for n, c in (("sum", "_sum"), ("mean", "_mean"), ("p50", "p50"), ("p90", "p90"), ("p95", "p95"), ("p99", "p99"), ("max", "_max"))))


def cost_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Throughput and tokens; the wall time is the sum of latencies."""
    wall = F.sum("latency_sec")
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("num_samples"), F.sum("num_steps").alias("num_steps"), F.count_if("error").alias("num_errors"), wall.alias("wall_time_sec"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        per(F.count("*"), wall).alias("samples_per_sec"), per(F.sum("num_steps"), wall).alias("steps_per_sec"), per(F.sum("completion_tokens"), F.count("*")).alias("tokens_per_sample"), per(F.sum("completion_tokens"), F.sum("num_steps")).alias("tokens_per_step"),
    )


def best_of_n(rows: DataFrame, n: int) -> DataFrame:
    """For each index, the first candidate of the greatest score among the first n; null and NaN scores don't count, minus infinity does."""
    live = rows.where((F.col("candidate_idx") < n) & F.col("score").isNotNull() & ~F.isnan("score"))
    return live.groupBy("index").agg(F.max_by("candidate_idx", F.struct("score", -F.col("candidate_idx"))).alias("best_idx"), F.max("score").alias("best_score"))


def majority_vote(rows: DataFrame, n: int) -> DataFrame:
    """For each index, the answer that most of the first n candidates give; ties go to the one seen first."""
    votes = rows.where((F.col("candidate_idx") < n) & F.col("answer").isNotNull()).groupBy("index", "answer").agg(F.count("*").alias("votes"), F.min("candidate_idx").alias("first_seen"))
    return votes.groupBy("index").agg(F.max_by("answer", F.struct("votes", -F.col("first_seen"))).alias("answer"), F.max("votes").alias("votes"), F.count("*").alias("num_unique_votes"))


def pass_at_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Share of indices with a hit among the candidates of index below k."""
    first = rows.groupBy("index").agg(F.min(F.when(F.col("hit"), F.col("candidate_idx"))).alias("first_hit"))
    each = first.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "first_hit")
    return each.groupBy("k").agg(F.count("*").alias("total"), F.count_if(F.col("first_hit") < F.col("k")).alias("hits"), F.avg(F.when(F.col("first_hit") < F.col("k"), 1.0).otherwise(0.0)).alias("pass_at_k"))


def wemath(rows: DataFrame, total: int = 525) -> DataFrame:
    """Knowledge taxonomy of problems in two or three steps.  rows: id, key, hit; a part that is missing counts as missed."""
    out = None
    for n in (2, 3):
        wide = rows.where(F.col("key").startswith(f"{n}steps_")).groupBy("id").agg(*(F.coalesce(F.bool_or(F.when(F.col("key") == f"{n}steps_{p}", F.col("hit"))), F.lit(False)).alias(f"j{p}") for p in (*range(1, n + 1), "multi")), F.count_if(F.col("key") == f"{n}steps_1").alias("_first"))
        parts = [F.col(f"j{i}") for i in range(1, n + 1)]
        every, some = parts[0], parts[0]
        for p in parts[1:]:
            every, some = every & p, some | p
        own = wide.where("_first > 0").select("id", every.alias("every"), some.alias("some"), F.col("jmulti").alias("multi"))
        out = own if out is None else out.unionAll(own)
    e, s, m = F.col("every"), F.col("some"), F.col("multi")
    counts = out.agg(
        F.count_if(e & ~m).alias("inadequate_generalization"), F.count_if(~e & ~m).alias("insufficient_knowledge"), F.count_if(s & m).alias("complete_mastery_loose"),
        F.count_if(e & m).alias("complete_mastery_strict"), F.count_if(~s & m).alias("rote_memorization_loose"), F.count_if(~e & m).alias("rote_memorization_strict"),
    )
    score = lambda k: (total - 0.5 * F.col("inadequate_generalization") - F.col(f"rote_memorization_{k}") - F.col("insufficient_knowledge")) / total
    return counts.withColumns({"score_strict": score("strict"), "score_loose": score("loose")})


def pending_rows(rows: DataFrame, results: DataFrame, key: str, seq: str, mode: str, retry_errors: bool = False, retry_invalid: bool = False, first_mode: str = "full") -> DataFrame:
    """Rows whose latest result does not count: there is none, it is of another mode (a result without one is of the first mode), or it has an error or could not be parsed and such are to be tried again.

    results: key, an order, reward_mode, error, parse_error.  A null key has no result.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    latest = latest_per_key(results.where(F.col(key).isNotNull()), key, seq)
    counts = F.coalesce("reward_mode", F.lit(first_mode)) == mode
    if retry_errors:
        counts &= ~some("error")
    if retry_invalid:
        counts &= ~some("parse_error")
    return rows.join(latest.where(counts).select(key), key, "left_anti")
