"""Rule rewards, as column expressions over arrays of labels, predictions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import responses


#: Counts that the step reward is made of; k is a class.
COUNTS = ["targets", "missing", "extra", *(f"{c}{k}" for k in (0, 1) for c in ("has", "hit", "wrong", "extra"))]


def step_counts(rows: DataFrame, by: str) -> DataFrame:
    """COUNTS of each source from step rows: label {0, 1, -1; null: no such step was asked for}, pred {0, 1; null: not answered}.

    Plain counts, combined before the shuffle: no list of steps is gathered.
    """
    label, pred, asked = F.col("label"), F.col("pred"), F.col("label").isNotNull()
    out = {"targets": F.count_if(asked), "missing": F.count_if(asked & pred.isNull()), "extra": F.count_if(~asked & pred.isNotNull())}
    for k in (0, 1):
        out |= {f"has{k}": F.count_if(label == k), f"hit{k}": F.count_if((label == k) & (pred == k)), f"wrong{k}": F.count_if((label == 1 - k) & (pred == k)), f"extra{k}": F.count_if(~asked & (pred == k))}
    return rows.groupBy(by).agg(*(c.alias(n) for n, c in out.items()))


def list_counts(labels: Column, entries: Column) -> Column:
    """COUNTS as a struct, in one pass over a list of labels and one over (step, score) entries of which no two have one step."""
    zero = F.struct(*(F.lit(0).alias(c) for c in COUNTS))
    n = F.size(labels)
    scores = F.map_from_entries(entries)
    one = lambda test: F.when(test, 1).otherwise(0)

    def asked(a: Column, x: Column) -> Column:
        label, pred = x["label"], x["pred"]
        new = {"targets": F.lit(1), "missing": one(pred.isNull()), "extra": F.lit(0)}
        for k in (0, 1):
            new |= {f"has{k}": one(label == k), f"hit{k}": one((label == k) & (pred == k)), f"wrong{k}": one((label == 1 - k) & (pred == k)), f"extra{k}": F.lit(0)}
        return F.struct(*((a[c] + new[c]).alias(c) for c in COUNTS))

    def beyond(a: Column, e: Column) -> Column:
        new = {"extra": one(e["step"] >= n)} | {f"extra{k}": one((e["step"] >= n) & (e["score"] == k)) for k in (0, 1)}
        return F.struct(*((a[c] + new.get(c, F.lit(0))).alias(c) for c in COUNTS))

    pairs = responses.once(scores, lambda s: F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.try_element_at(s, i.cast("bigint")).alias("pred"))))
    return F.aggregate(entries, F.aggregate(pairs, zero, asked), beyond)


def class_f1(k: int) -> Column:
    """F1 of a class from COUNTS: a step that was not asked for is a false positive; null if the class is in no label and in no such step."""
    wrong = F.col(f"wrong{k}") + F.col(f"extra{k}")
    f1 = F.coalesce(F.try_divide(2.0 * F.col(f"hit{k}"), F.col(f"hit{k}") + F.col(f"has{k}") + wrong), F.lit(0.0))
    return F.when((F.col(f"has{k}") > 0) | (F.col(f"extra{k}") > 0), f1)


def step_metrics(rows: DataFrame, count_weight: float = 0.05) -> DataFrame:
    """Rows with COUNTS, and with the fifteen outputs of the step reward; all but the counts are 0 where no label is confident."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    confident = F.col("has0") + F.col("has1")
    f0, f1 = class_f1(0), class_f1(1)
    both = F.when(f0.isNotNull(), 1).otherwise(0) + F.when(f1.isNotNull(), 1).otherwise(0)
    kinds = F.when(F.col("has0") > 0, 1).otherwise(0) + F.when(F.col("has1") > 0, 1).otherwise(0)
    out = rows.withColumns(
        {
            "confident": confident, "count": F.greatest(F.lit(0.0), 1.0 - (F.col("extra") + F.col("missing")) / F.greatest(F.col("targets"), F.lit(1))),
            "raw_macro_f1": share(F.coalesce(f0, F.lit(0.0)) + F.coalesce(f1, F.lit(0.0)), both), "negative_f1": F.coalesce(f0, F.lit(0.0)), "positive_f1": F.coalesce(f1, F.lit(0.0)),
            "accuracy": share(F.col("hit0") + F.col("hit1"), confident), "negative_accuracy": share(F.col("hit0"), F.col("has0")), "positive_accuracy": share(F.col("hit1"), F.col("has1")),
            "pred_negative_ratio": share(F.col("hit0") + F.col("wrong0"), confident),
            "parsed_steps": (F.col("targets") - F.col("missing") + F.col("extra")).cast("double"), "target_steps": F.col("targets").cast("double"), "extra_steps": F.col("extra").cast("double"), "missing_steps": F.col("missing").cast("double"),
        }
    )
    out = out.withColumns({"macro_f1": F.least("raw_macro_f1", "count"), "balanced_accuracy": share(F.col("negative_accuracy") + F.col("positive_accuracy"), kinds)})
    out = out.withColumn("step", (1 - count_weight) * F.col("macro_f1") + count_weight * F.col("count"))
    blank = ["step", "accuracy", "macro_f1", "raw_macro_f1", "negative_f1", "positive_f1", "balanced_accuracy", "negative_accuracy", "positive_accuracy", "pred_negative_ratio"]
    return out.withColumns({c: F.when(F.col("confident") > 0, F.col(c)).otherwise(0.0) for c in blank}).drop("confident", *COUNTS)


#: What step_metrics() adds.
STEP_OUTPUTS = ["step", "accuracy", "macro_f1", "raw_macro_f1", "negative_f1", "positive_f1", "balanced_accuracy", "negative_accuracy", "positive_accuracy", "count", "pred_negative_ratio", "parsed_steps", "target_steps", "extra_steps", "missing_steps"]


def localize(declared: Column, labels: Column) -> Column:
    """1 if the declared first error is the first label of 0 (-1: there is none), else 0; 0 too for none declared or one that no step has."""
    truth = F.array_position(labels, 0) - 1
    return F.when((declared == truth) & (declared >= -1) & (declared < F.size(labels)), 1.0).otherwise(0.0)


def response_rewards(rows: DataFrame, localized: bool = False) -> DataFrame:
    """Rows with the rewards of whole responses.  rows: response, labels {0, 1, -1}.

    overall is the weighted mean of step, format and think; with `localized` also of cons, the
    lesser of macro-F1 and localize, under the weights of that variant.
    """
    weights = {"step": 0.75, "cons": 0.20, "format": 0.04, "think": 0.01} if localized else {"step": 0.92, "format": 0.05, "think": 0.03}
    out = rows.withColumn("_blocks", responses.read_blocks(F.col("response"))).withColumns({f"_{n}": F.col(f"_blocks.{n}") for n in ("think", "answer", "format")})
    out = out.withColumn("_entries", responses.last_of_each(responses.step_scores(F.col("_answer"))))
    out = out.withColumn("_counts", list_counts(F.col("labels"), F.col("_entries")))
    out = step_metrics(out.select("*", "_counts.*"), 0.15 if localized else 0.05)
    out = out.withColumn("think", think_score(F.col("_think"), 80, 2400 if localized else 1800))
    if localized:
        out = out.withColumn("_declared", responses.first_error(F.col("_answer"))).withColumn("localize", localize(F.col("_declared"), F.col("labels")))
        out = out.withColumns({"cons": F.least("macro_f1", "localize"), "format": F.when(F.col("_declared").isNotNull(), F.least(F.lit(1.0), F.col("_format") + 0.05)).otherwise(F.col("_format"))})
        out = out.withColumns({"first_error_pred": F.coalesce(F.col("_declared").cast("double"), F.lit(-1.0)), "first_error_target": (F.array_position("labels", 0) - 1).cast("double")})
    else:
        out = out.withColumn("format", F.col("_format"))
    total = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return out.withColumn("overall", total).drop(*(c for c in out.columns if c.startswith("_")))


def think_score(text: Column, least: int = 80, most: int = 1800) -> Column:
    """A ramp up to `least` characters and a decay beyond `most`."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0.0).when(n < least, n / least).when(n > most, F.greatest(F.lit(0.0), 1.0 - (n - most) / most)).otherwise(1.0)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to limit - buffer, then down in proportion to the excess."""
    return F.least(F.lit(0.0), -(length - (limit - buffer)) / buffer * factor)


def cosine_length(length: Column, longest: int, low: float, high: float) -> Column:
    """From high at length 0 to low at the longest, along a cosine."""
    return low + 0.5 * (high - low) * (1 + F.cos(F.least(length, F.lit(longest)) * F.pi() / longest))


def repetition_penalty(rows: DataFrame, text: str, n: int, most: float) -> DataFrame:
    """Rows with penalty: (1 - distinct n-grams / n-grams) * most, over lower-case words; 0 for blank and short texts.

    Words and n-grams are hashed once each, in columns of their own, and no row leaves its task.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    out = rows.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.when(F.size("_h") >= n, F.slice("_h", F.lit(1), F.size("_h") - (n - 1)))
    out = out.withColumn("_g", F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get("_h", i + k) for k in range(1, n)))))
    return out.withColumn("penalty", F.coalesce((1.0 - F.size(F.array_distinct("_g")) / F.size("_g")) * most, F.lit(0.0))).drop("_h", "_g")
