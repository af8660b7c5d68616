"""Rows of named text datasets in the standard form, as column expressions.

Each takes a DataFrame with the columns that it names and returns messages or labels.  The
marks that are stripped or added are fixed values of those datasets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.conversations import alpaca_query

PREPROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def preprocessor(name: str) -> Callable:
    """Register a preprocessor."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in PREPROCESSORS:
            raise ValueError(f"preprocessor {name} is registered twice")
        PREPROCESSORS[name] = f
        return f

    return put


def pair(query: Column, response: Column) -> Column:
    """Messages of one query and response."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", query), ("assistant", response)))).alias("messages")


@preprocessor("alpaca")
def _alpaca(df: DataFrame) -> DataFrame:
    return df.select(pair(alpaca_query(F.col("instruction"), F.col("input")), F.col("output")))


@preprocessor("alpaca-zh")
def _alpaca_zh(df: DataFrame) -> DataFrame:
    return df.select(pair(alpaca_query(F.col("instruction"), F.regexp_replace("input", "^输入：", "")), F.col("output")))


@preprocessor("long-alpaca")
def _long_alpaca(df: DataFrame) -> DataFrame:
    return df.select(pair(F.col("instruction"), F.regexp_replace("output", "^Answer: ", "")))


@preprocessor("dolly")
def _dolly(df: DataFrame) -> DataFrame:
    context = F.nullif(F.col("context"), F.lit(""))
    query = F.when(context.isNotNull(), F.concat(F.lit("Context: "), context, F.lit("\n\nInstruction: "), F.col("instruction"))).otherwise(F.col("instruction"))
    return df.select(pair(query, F.col("response")))


@preprocessor("hc3")
def _hc3(df: DataFrame) -> DataFrame:
    """Two labelled rows for each question: the person's answer and the model's."""
    rows = F.array(F.struct(F.get("human_answers", 0).alias("text"), F.lit(0).alias("label")), F.struct(F.get("chatgpt_answers", 0).alias("text"), F.lit(1).alias("label")))
    return df.select("question", F.inline(rows)).where("text is not null")


@preprocessor("stsb")
def _stsb(df: DataFrame) -> DataFrame:
    """Pairs of a high score only."""
    return df.where(F.col("score") >= 0.75).select(pair(F.col("sentence1"), F.col("sentence2")))


@preprocessor("hh-rlhf")
def _hh_rlhf(df: DataFrame) -> DataFrame:
    """Dialogues with `Human:` and `Assistant:` marks, and the reply that was turned down."""
    split = lambda c: F.filter(F.split(c, r"\n\n(?:Human|Assistant): "), lambda x: x != "")
    turns = split(F.col("chosen"))
    messages = F.transform(turns, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.trim(x).alias("content")))
    rejected = F.trim(F.element_at(split(F.col("rejected")), -1))
    out = df.select(messages.alias("messages"), rejected.alias("rejected_response"))
    return out.where(F.element_at("messages", -1)["content"] != F.col("rejected_response"))


@preprocessor("kind-filter")
def _kinds(df: DataFrame) -> DataFrame:
    return df.where(F.col("kind").isin("NLI", "Summary", "Translation")).select(pair(F.col("input"), F.col("target")))


@preprocessor("multi-hot")
def _multi_hot(df: DataFrame) -> DataFrame:
    """Places of the ones in a list."""
    return df.select(F.filter(F.transform("labels", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull()).alias("label"))


def boxes(objects: Column) -> Column:
    """Boxes with corners in order; lengths other than 2 and 4 become null."""
    low = lambda b, i, j: F.least(F.get(b, i), F.get(b, j))
    high = lambda b, i, j: F.greatest(F.get(b, i), F.get(b, j))
    return F.transform(objects, lambda b: F.when(F.size(b) == 4, F.array(low(b, 0, 2), low(b, 1, 3), high(b, 0, 2), high(b, 1, 3))).when(F.size(b) == 2, b))


def scaled(box: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """A box in thousandths of the picture, rounded half to even."""
    return F.transform(box, lambda v, i: F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * scale).cast("int"))
