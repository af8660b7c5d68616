"""Divergences of a student's distribution over tokens from a teacher's, on rows of position, token and logit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A row for all tokens that not both sides name.
TAIL = -1


def full_kl(log_probs: Column, reference: Column) -> Column:
    """The divergence of whole distributions in arrays of log-probabilities: the sum of p * (log p - log q)."""
    return F.aggregate(F.zip_with(log_probs, reference, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)


def _times(p: Column, log: Column) -> Column:
    """p * log, with 0 for p = 0."""
    return F.when(p > 0, p * log).otherwise(0.0)


def _jsd(s: Column, t: Column, beta: float) -> Column:
    """A token's part of the divergence, from both chances."""
    kl = lambda p, q: F.when(p > 0, F.when(q > 0, _times(p, F.log(p) - F.log(q))).otherwise(float("inf"))).otherwise(0.0)
    if beta == 0:
        return kl(t, s)
    if beta == 1:
        return kl(s, t)
    m = (1 - beta) * s + beta * t
    return beta * kl(t, m) + (1 - beta) * kl(s, m)


def _softmax(values: Column, at: W) -> Column:
    """Chances from logits within a position; minus infinity and null are no chance."""
    top = F.max(values).over(at)
    e = F.coalesce(F.exp(values - top), F.lit(0.0))
    return e / F.sum(e).over(at)


def divergence(student: DataFrame, teacher: DataFrame, by: list[str], beta: float = 0.5, temperature: float = 1.0, mode: str = "vocabulary") -> DataFrame:
    """by, divergence (0: teacher from student, 1: student from teacher, between: the generalised Jensen-Shannon divergence) and how many tokens it is over.

    Rows: by, token, logit.  Positions that one side does not have are left out.  Modes:

    - vocabulary: both sides are whole vocabularies; a token that one has not takes the other's logit.
    - topk: over the teacher's tokens only, both sides scaled anew to one; one that the student has not has no chance.
      Positions where the teacher has only minus infinity are left out.
    - tail: both sides name their best tokens by log-probabilities (the temperature is not used); tokens that both
      name count each, and all others are one bucket with the rest of either side's chance.  This is at
      most the divergence of the whole distributions.

    A position is a group of at most a vocabulary's tokens, and all steps share its one shuffle.
    """
    if mode not in ("vocabulary", "topk", "tail"):
        raise ValueError(f"unknown mode: {mode}")
    s = student.select(*by, "token", F.col("logit").cast("double").alias("_s"), F.lit(True).alias("_hs"))
    t = teacher.select(*by, "token", F.col("logit").cast("double").alias("_t"), F.lit(True).alias("_ht"))
    both = s.repartition(*by).join(t.repartition(*by), [*by, "token"], "full")
    at = W.partitionBy(*by)
    met = both.withColumns({"_any_s": F.max("_hs").over(at), "_any_t": F.max("_ht").over(at)}).where("_any_s and _any_t")
    if mode == "tail":
        pair = met.where("_hs and _ht").select(*by, F.exp("_s").alias("ps"), F.exp("_t").alias("pt"))
        each = pair.groupBy(*by).agg(F.sum(_jsd(F.col("ps"), F.col("pt"), beta)).alias("d"), F.sum("ps").alias("ps"), F.sum("pt").alias("pt"), F.count("*").alias("tokens"))
        apart = met.groupBy(*by).agg(F.count_if(F.col("_hs") & F.col("_ht")).alias("_n")).where("_n = 0").select(*by, F.lit(0.0).alias("d"), F.lit(0.0).alias("ps"), F.lit(0.0).alias("pt"), F.lit(0).cast("bigint").alias("tokens"))
        rest = lambda c: F.greatest(F.lit(0.0), 1.0 - F.col(c))
        return each.unionByName(apart).select(*by, (F.col("d") + _jsd(rest("ps"), rest("pt"), beta)).alias("divergence"), "tokens")
    if mode == "topk":
        met = met.where("_ht").withColumn("_some", F.max(F.when(F.col("_t") > float("-inf"), True)).over(at)).where("_some")
    else:
        met = met.withColumns({"_s": F.when(F.col("_hs"), F.col("_s")).otherwise(F.col("_t")), "_t": F.when(F.col("_ht"), F.col("_t")).otherwise(F.col("_s"))})
    chances = met.select(*by, _softmax(F.col("_s") / temperature, at).alias("ps"), _softmax(F.col("_t") / temperature, at).alias("pt"))
    # never negative but by rounding
    return chances.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(_jsd(F.col("ps"), F.col("pt"), beta))).alias("divergence"), F.count("*").alias("tokens"))


def distillation_loss(divergences: DataFrame) -> DataFrame:
    """The total over positions, and how many there are."""
    return divergences.agg(F.coalesce(F.sum("divergence"), F.lit(0.0)).alias("total"), F.count("*").alias("num_valid"))
