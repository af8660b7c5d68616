"""Conversations: building, normalising, checking and weighing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role names of other formats (fixed values).
ROLE_ALIASES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "assistant": "assistant", "system": "system", "observation": "tool", "tool": "tool", "tool_response": "tool", "function_call": "tool_call"}


def canonical_role(role: Column) -> Column:
    """The standard name of a role."""
    table = F.create_map(*(F.lit(x) for kv in ROLE_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(role)), role)


def messages(turns: DataFrame) -> DataFrame:
    """conv_id and its messages in order."""
    m = F.struct("turn", canonical_role(F.col("role")).alias("role"), F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def valid(m: Column) -> Column:
    """Whether there are messages, all of known roles with content."""
    return (F.size(m) > 0) & F.forall(m, lambda x: x["role"].isin("system", "user", "assistant", "tool", "tool_call") & F.coalesce(x["content"] != "", F.lit(False)))


def from_query(query: Column, response: Column, history: Column, system: Column | None = None) -> Column:
    """Messages of a system text, earlier pairs, a query and a response; null turns are left out."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.array(one("system", system)) if system is not None else F.array().cast("array<struct<role:string,content:string>>")
    past = F.flatten(F.transform(history, lambda h: F.array(one("user", F.get(h, 0)), one("assistant", F.get(h, 1)))))
    return F.filter(F.concat(head, past, F.array(one("user", query), one("assistant", response))), lambda x: x["content"].isNotNull())


def alpaca_query(instruction: Column, text: Column) -> Column:
    """Instruction and input on two lines, when both are there."""
    return F.concat_ws("\n", F.nullif(instruction, F.lit("")), F.nullif(text, F.lit("")))


def to_history(m: Column) -> Column:
    """Pairs of user and assistant texts; a last query without a reply gets null."""
    rest = F.filter(m, lambda x: x["role"] != "system")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(rest) / 2).cast("int") - 1), lambda i: F.array(F.get(rest, 2 * i)["content"], F.get(rest, 2 * i + 1)["content"]))


def loss_weights(m: Column, strategy: str = "default") -> Column:
    """A loss weight for each message: of assistants, of the last round's assistant, or of all."""
    if strategy == "all":
        return F.transform(m, lambda x: F.lit(1.0))
    last = F.size(m) - 1
    if strategy == "last_round":
        return F.transform(m, lambda x, i: F.when((x["role"] == "assistant") & (i == last), 1.0).otherwise(0.0))
    return F.transform(m, lambda x: F.when(x["role"] == "assistant", 1.0).otherwise(0.0))


def transcript(m: Column) -> Column:
    """One line of role and text for each message."""
    return F.array_join(F.transform(m, lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), F.coalesce(x["content"], F.lit("")))), "\n")


def drop_last_reply(m: Column) -> Column:
    """Messages up to the last one, if that is the assistant's."""
    return F.when(F.try_element_at(m, F.lit(-1))["role"] == "assistant", F.slice(m, 1, F.size(m) - 1)).otherwise(m)


def class_balance(rows: DataFrame, label: str, desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> DataFrame:
    """desirable and undesirable (rows of label 1 and of the rest, 1 at least), bounds of each side's weight by the other's, and in_range: whether one weight is within its bounds; no bounds are needed where both sides are equal."""
    counts = rows.agg(F.greatest(F.coalesce(F.sum(label), F.lit(0)), F.lit(1)).alias("desirable"), F.count("*").alias("_n")).select("desirable", F.greatest(F.col("_n") - F.col("desirable"), F.lit(1)).alias("undesirable"))
    p, u = F.col("desirable"), F.col("undesirable")
    bound = lambda x: F.when(p != u, F.bround(x, 2))
    out = counts.withColumns({
        "desirable_low": bound(u * F.lit(undesirable_weight) / p), "desirable_high": bound(u * F.lit(undesirable_weight) / p * 1.33),
        "undesirable_low": bound(p * F.lit(desirable_weight) / u / 1.33), "undesirable_high": bound(p * F.lit(desirable_weight) / u),
    })
    within = F.lit(desirable_weight).between(F.col("desirable_low"), F.col("desirable_high")) | F.lit(undesirable_weight).between(F.col("undesirable_low"), F.col("undesirable_high"))
    return out.withColumn("in_range", F.coalesce(within, F.lit(True)))
