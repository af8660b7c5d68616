"""Advantages, returns, divergences and weights of reinforcement learning rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_stats(rows: DataFrame, by: str = "uid", value: str = "reward") -> DataFrame:
    """Rows with the mean, sample deviation (0 for one row), count, sum and maximum of their group; as an aggregate and a join, so that a hot group is combined before the shuffle and its rows may be split."""
    stats = rows.groupBy(by).agg(F.avg(value).alias("g_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("g_std"), F.count(value).alias("g_n"), F.sum(value).alias("g_sum"))
    return rows.join(stats, by)


ESTIMATORS: dict[str, Callable[[Column], Column]] = {}


def estimator(name: str) -> Callable:
    """Register an advantage as an expression over group_stats()."""

    def put(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name} is registered twice")
        ESTIMATORS[name] = f
        return f

    return put


@estimator("grpo")
def _grpo(r: Column) -> Column:
    return (r - F.col("g_mean")) / (F.col("g_std") + 1e-6)


@estimator("grpo_trainer")
def _grpo_trainer(r: Column) -> Column:
    return (r - F.col("g_mean")) / (F.col("g_std") + 1e-4)


@estimator("mean_only")
def _mean_only(r: Column) -> Column:
    return r - F.col("g_mean")


@estimator("rloo")
def _rloo(r: Column) -> Column:
    return r - F.try_divide(F.col("g_sum") - r, F.col("g_n") - 1)


def advantage(rows: DataFrame, name: str, value: str = "reward") -> DataFrame:
    """uid, item and the named advantage; groups of one row have none by rloo."""
    return group_stats(rows, value=value).select("uid", "item", ESTIMATORS[name](F.col(value)).alias("advantage"))


def pass_k_advantage(rows: DataFrame) -> DataFrame:
    """(best - second) / (deviation + eps) for the group's best row, 0 for others; of equal bests, the least item."""
    best = rows.groupBy("uid").agg(F.max(F.struct("reward", -F.col("item"))).alias("top"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    joined = rows.join(best, "uid")
    second = joined.where(F.col("item") != -F.col("top.col2")).groupBy("uid").agg(F.max("reward").alias("second"))
    out = joined.join(second, "uid", "left")
    gap = (F.col("top.reward") - F.coalesce("second", "top.reward")) / (F.col("std") + 1e-6)
    return out.select("uid", "item", F.when(F.col("item") == -F.col("top.col2"), gap).otherwise(F.lit(0.0)).alias("advantage"))


def online_filter(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean lies strictly between the bounds."""
    keep = rows.groupBy("uid").agg(F.avg("reward").alias("m")).where((F.col("m") > low) & (F.col("m") < high)).select("uid")
    return rows.join(keep, "uid", "left_semi")


def dynamic_sampling(rows: DataFrame) -> DataFrame:
    """Rows of groups whose rewards differ."""
    keep = rows.groupBy("uid").agg(F.stddev_samp("reward").alias("s")).where("s > 0").select("uid")
    return rows.join(keep, "uid", "left_semi")


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma R_{t+1}, from the end, with R = 0 after a token that is masked out."""
    step = F.aggregate(
        F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m"))),
        F.struct(F.lit(0.0).alias("next"), F.array().cast("array<double>").alias("out")),
        lambda a, x: F.struct((x["r"] + gamma * a["next"]).__mul__(x["m"]).alias("next"), F.concat(a["out"], F.array(x["r"] + gamma * a["next"])).alias("out")),
    )
    return F.reverse(step["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages, from the end; a masked token neither moves the value nor the running advantage."""
    step = F.aggregate(
        F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m"))),
        F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out")),
        lambda a, x: _gae_step(a, x, gamma, lam),
    )
    return F.reverse(step["out"])


def _gae_step(a: Column, x: Column, gamma: float, lam: float) -> Column:
    last = x["r"] + gamma * a["value"] - x["v"] + gamma * lam * a["last"]
    kept = F.when(x["m"] > 0, last).otherwise(a["last"])
    return F.struct(F.when(x["m"] > 0, x["v"]).otherwise(a["value"]).alias("value"), kept.alias("last"), F.concat(a["out"], F.array(kept)).alias("out"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def token_kl(logp: Column, ref: Column, kind: str) -> Column:
    """A token's divergence estimate."""
    if kind == "kl":
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind == "mse":
        return 0.5 * (logp - ref) * (logp - ref)
    if kind == "low_var_kl":
        d = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(d) - d - 1, -10.0, 10.0)
    raise ValueError(f"unknown divergence {kind}")


def importance(ratio: Column, sequence_ratio: Column, mode: str, threshold: float) -> Column:
    """Correction weights by token or sequence, truncated or masked."""
    return {
        "token_truncate": F.least(ratio, F.lit(threshold)),
        "token_mask": F.when(ratio <= threshold, ratio).otherwise(0.0),
        "sequence_truncate": F.least(sequence_ratio, F.lit(threshold)),
        "sequence_mask": F.when(sequence_ratio <= threshold, ratio).otherwise(0.0),
    }[mode]


def islands(rows: DataFrame, order: str, starts: Column) -> DataFrame:
    """Rows with the number of starts up to them (0 before the first), in order.

    Running counts within ranges of the order column, as many rows in each as there are ranges,
    and over the ranges' totals: no task sees all rows.
    """
    n, lo, hi = rows.agg(F.count("*"), F.min(order), F.max(order)).first()
    blocks = max(1, int(n**0.5) // 100)
    width = max(1.0, (float(hi or 0) - float(lo or 0) + 1) / blocks)
    live = rows.withColumn("_b", F.floor((F.col(order) - F.lit(lo or 0)) / width)).withColumn("_s", F.when(starts, 1).otherwise(0))
    totals = live.groupBy("_b").agg(F.sum("_s").alias("_t"))
    before = totals.select(F.col("_b"), (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_before"))  # at most `blocks` rows
    inner = F.sum("_s").over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return live.withColumn("_i", inner).join(before, "_b").withColumn("island", F.col("_i") + F.col("_before")).drop("_b", "_s", "_i", "_before")


def adaptive_coefficient(rows: DataFrame, by: list[str], order: str, kl: str, steps: str, target: float, horizon: float, start: float) -> DataFrame:
    """Rows with the coefficient after each update: it is multiplied by 1 + clip(kl / target - 1, -0.2, 0.2) * steps / horizon, which may be zero or negative.

    A running product: the logarithms of the sizes are summed, and the signs and zeros counted.
    """
    factor = 1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(kl) / target - 1)) * F.col(steps) / horizon
    so_far = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    live = rows.withColumn("_f", factor)
    size = F.exp(F.coalesce(F.sum(F.log(F.nullif(F.abs("_f"), F.lit(0.0)))).over(so_far), F.lit(0.0)))
    zeros, negative = F.sum(F.when(F.col("_f") == 0, 1).otherwise(0)).over(so_far), F.sum(F.when(F.col("_f") < 0, 1).otherwise(0)).over(so_far)
    return live.withColumn("coefficient", F.when(zeros > 0, 0.0).otherwise(start * size * F.when(negative % 2 == 0, 1).otherwise(-1))).drop("_f")
