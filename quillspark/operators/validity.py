"""Rows that fail a check: dropped and counted, or the whole job stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Roles that a conversation may have (fixed values).
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")


def first_reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that a row fails (a check that comes to null is failed), or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(name)
    return out


def checked(rows: DataFrame, checks: dict[str, Column], strict: bool, observation: Observation | None = None) -> DataFrame:
    """The rows that pass all checks.

    Strict: an action on them fails at a row that does not, with its reason.  Else such rows are dropped,
    and the observation counts them by reason, as an action passes over them (`kept` counts the others).
    """
    marked = rows.withColumn("_reason", first_reason(checks))
    if observation is not None:
        counts = [F.count_if(F.col("_reason") == name).alias(name) for name in checks]
        marked = marked.observe(observation, F.count_if(F.col("_reason").isNull()).alias("kept"), *counts)
    if strict:
        stop = F.raise_error(F.concat(F.lit("a row fails the check "), F.col("_reason"))).cast("boolean")
        return marked.where(F.when(F.col("_reason").isNotNull(), stop).otherwise(F.lit(True))).drop("_reason")
    return marked.where("_reason is null").drop("_reason")


def reason_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows by the first check that they fail (`ok`: none)."""
    return rows.groupBy(F.coalesce(first_reason(checks), F.lit("ok")).alias("reason")).agg(F.count("*").alias("rows"))


def message_checks(messages: Column, rejected: Column | None = None) -> dict[str, Column]:
    """Checks of a conversation: there are messages, of known roles, each with content, and a rejected response differs from the last message."""
    out = {
        "no_messages": F.size(messages) > 0,
        "bad_role": F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))),
        "no_content": F.forall(messages, lambda m: m["content"].isNotNull()),
    }
    if rejected is not None:
        out["rejected_is_chosen"] = rejected.isNull() | ~rejected.eqNullSafe(F.try_element_at(messages, F.lit(-1))["content"])
    return out


def box_checks(boxes: Column) -> dict[str, Column]:
    """Every box is a point or two corners."""
    return {"bad_box": boxes.isNull() | F.forall(boxes, lambda b: F.coalesce(F.size(b).isin(2, 4), F.lit(False)))}


def length_checks(lengths: Column, most: int) -> dict[str, Column]:
    """No length, or no length of a list, is beyond the greatest."""
    return {"too_long": lengths <= most}
