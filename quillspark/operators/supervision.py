"""Step supervision: labels, filters, summaries and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.labels import RL_TAU_POSITIVE, RL_UNCERTAIN, polarity, step_label


def hash_order(seed: str, *columns: str) -> Column:
    """A pseudo-random order that does not depend on partitions: rows by the MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def step_f1(rows: DataFrame, by: str = "data_source") -> DataFrame:
    """Step macro-F1 per source and over all (null): neutral steps drop out; -2 counts against the true class only.  rows: by, truth {1, 0, -1}, pred {1, -1, -2}."""
    scored = rows.where("truth <> 0").groupingSets([[F.col(by)], []], F.col(by)).agg(
        *(F.count_if((F.col("truth") == k) & (F.col("pred") == k)).alias(f"tp_{n}") for n, k in (("pos", 1), ("neg", -1))),
        *(F.count_if((F.col("truth") != k) & (F.col("pred") == k)).alias(f"fp_{n}") for n, k in (("pos", 1), ("neg", -1))),
        *(F.count_if((F.col("truth") == k) & (F.col("pred") != k)).alias(f"fn_{n}") for n, k in (("pos", 1), ("neg", -1))),
        F.count_if(F.col("pred") == -2).alias("invalid_predictions"),
        F.count("*").alias("steps"),
    )
    f1 = {n: F.coalesce(F.try_divide(2.0 * F.col(f"tp_{n}"), 2 * F.col(f"tp_{n}") + F.col(f"fp_{n}") + F.col(f"fn_{n}")), F.lit(0.0)) for n in ("pos", "neg")}
    return scored.select(by, "steps", "invalid_predictions", f1["pos"].alias("f1_positive"), f1["neg"].alias("f1_negative"), ((f1["pos"] + f1["neg"]) / 2).alias("macro_f1"))


def polarity_counts(sources: DataFrame) -> DataFrame:
    """Selected sources and labelled steps of each annotation, without calling a teacher."""
    flags = polarity(F.col("scores"))
    labels = F.transform("scores", lambda x: step_label(x))
    out = sources.select("source_annotation", *(c.alias(n) for n, c in flags.items()), F.size(F.filter(labels, lambda x: x == 0)).alias("n0"), F.size(F.filter(labels, lambda x: x == 1)).alias("n1"), F.size(F.filter(labels, lambda x: x.isNull())).alias("nu"))
    return out.groupBy("source_annotation").agg(*(F.count_if(F.col(n)).alias(n) for n in flags), F.sum("n0").alias("negative_steps"), F.sum("n1").alias("positive_steps"), F.sum("nu").alias("uncertain_steps"))


def reject_reason(scores: Column, low: float = 0.125, high: float = RL_TAU_POSITIVE) -> Column:
    """The first reason, in a fixed order, for which a source is no training case; `ok` if none holds."""
    labels = F.transform(scores, lambda x: step_label(x, low, high, RL_UNCERTAIN))
    return (
        F.when(scores.isNull() | (F.size(scores) == 0), "missing_image_or_steps")
        .when(F.exists(scores, lambda x: x.isNull()), "bad_score")
        .when(F.exists(labels, lambda x: x == -1), "fuzzy_step")
        .when(~F.exists(labels, lambda x: x != -1), "no_confident_step")
        .otherwise("ok")
    )


def source_summary(sources: DataFrame) -> DataFrame:
    """Sizes, labels and categories of the accepted sources."""
    labels = F.transform("scores", lambda x: step_label(x, uncertain=RL_UNCERTAIN))
    rows = sources.select("source_annotation", F.size("scores").alias("n"), F.size(F.filter(labels, lambda x: x == 0)).alias("neg"), F.size(F.filter(labels, lambda x: x == 1)).alias("pos"))
    return rows.groupBy("source_annotation").agg(
        F.count("*").alias("samples"), F.min("n").alias("min_steps"), F.max("n").alias("max_steps"), F.sum("n").alias("steps"), F.sum("neg").alias("negative_steps"), F.sum("pos").alias("positive_steps"),
        F.count_if(F.col("neg") > 0).alias("with_negative"), F.count_if((F.col("neg") == 0) & (F.col("pos") > 0)).alias("all_positive"), F.coalesce(F.try_divide(F.sum("neg").cast("double"), F.sum("neg") + F.sum("pos")), F.lit(0.0)).alias("negative_ratio"),
    )


def multiturn(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Conversation counters: a step is trained on if it has a confident label and a judged row.

    heads: source_key, scores, teacher; rows: source_key, step_index, judged.  Keys may be null (null-safe join).
    """
    wide = heads.select("source_key", F.posexplode("scores").alias("step_index", "score"), "teacher")
    own = wide.join(rows.withColumnRenamed("source_key", "k").withColumnRenamed("step_index", "i"), F.expr("source_key <=> k and step_index = i"), "left")
    label = step_label(F.col("score"))
    teacher = F.try_element_at("teacher", F.col("step_index") + 1)
    trained = label.isNotNull() & F.col("judged").isNotNull()
    value = F.when(trained, F.col("judged")).when(label.isNotNull(), F.coalesce(teacher, label)).otherwise(F.coalesce(teacher, F.lit(0)))
    each = own.select("source_key", "step_index", trained.alias("trained"), value.alias("value"), (label.isNotNull() & F.col("judged").isNull()).alias("missing"))
    return each.groupBy("source_key").agg(
        F.count("*").alias("num_steps"), F.count_if("trained").alias("num_trainable_steps"), F.count_if(~F.col("trained")).alias("num_ignored_steps"),
        F.count_if(F.col("trained") & (F.col("value") == 0)).alias("negative_trainable_steps"), F.count_if(F.col("trained") & (F.col("value") == 1)).alias("positive_trainable_steps"),
        F.count_if("missing").alias("missing_confident_steps"),
    )


def pick_until(rows: DataFrame, weight: str, needed: float, order: list[Column], blocks: int = 64) -> DataFrame:
    """Rows in order until their weights first reach `needed`; rows of weight 0 are passed over, and the last may overshoot.

    The running sum is taken within ranges of a hash of the order and over the ranges' totals, so no task sorts all rows.
    """
    live = rows.where(F.col(weight) > 0).withColumn("_block", F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int") * blocks / 65536)
    live = live.withColumn("_block", F.col("_block").cast("int"))
    totals = live.groupBy("_block").agg(F.sum(weight).alias("_t"))
    before = totals.select(F.col("_block"), (F.sum("_t").over(W.orderBy("_block")) - F.col("_t")).alias("_before"))
    inner = F.sum(weight).over(W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(weight)
    return live.withColumn("_inner", inner).join(F.broadcast(before), "_block").where(F.col("_inner") + F.col("_before") < needed).drop("_block", "_inner", "_before")


def stratified(rows: DataFrame, by: str, fraction: float, order: list[Column]) -> DataFrame:
    """max(1, round half even(n * fraction)) rows of each stratum, in a hash order."""
    sizes = rows.groupBy(by).agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction).cast("bigint")).alias("_take"))
    return top_by_hash(rows, by, sizes, order)


def top_by_hash(rows: DataFrame, by: str, takes: DataFrame, order: list[Column], blocks: int = 256) -> DataFrame:
    """The first `_take` rows of each group in the order of a hash, without sorting a group in one task: ranks within blocks of the hash, and the blocks' counts before."""
    live = rows.withColumn("_block", F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int") * F.lit(blocks) / 65536)
    live = live.withColumn("_block", F.col("_block").cast("int"))
    counts = live.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_block", (F.sum("_n").over(W.partitionBy(by).orderBy("_block")) - F.col("_n")).alias("_before"))
    ranked = live.withColumn("_rank", F.row_number().over(W.partitionBy(by, "_block").orderBy(*order)))
    out = ranked.join(before, [by, "_block"]).join(takes, by).where(F.col("_rank") + F.col("_before") <= F.col("_take"))
    return out.drop("_block", "_rank", "_before", "_take")


def even_quotas(sizes: dict[str, int], total: int | None) -> dict[str, int]:
    """Quotas as even as the sizes allow: a level up to which every file gives, the remainder to the first files by name that can give one more."""
    if not total or total <= 0:
        return dict(sizes)
    left = min(total, sum(sizes.values()))
    out: dict[str, int] = {}
    waiting = sorted(sizes, key=lambda k: (sizes[k], k))
    for i, name in enumerate(waiting):
        level = left // (len(waiting) - i)
        if sizes[name] > level:
            rest = sorted(waiting[i:])
            extra = left - level * len(rest)
            return out | {k: level + (j < extra) for j, k in enumerate(rest)}
        out[name] = sizes[name]
        left -= sizes[name]
    return out
