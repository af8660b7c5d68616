"""Datasets of several forms as rows of standard columns: conversations, instructions, and queries with responses.

The form is told by the columns, before anything runs.  Conversations may be arrays of structs or
maps, variants, or texts of JSON or of Python literals; all are read as variants, so that each
message may name its fields as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, VariantType

from quillspark.functions.toolcalls import lenient_json
from quillspark.operators.conversations import alpaca_query, from_query
from quillspark.sources.readers import rename_columns

# Names that other formats have for columns, fields and roles.
MESSAGE_COLUMNS = {"messages": "messages", "conversation": "messages", "conversations": "messages", "system": "system", "system_prompt": "system"}
RESPONSE_COLUMNS = (
    dict.fromkeys(["system", "system_prompt"], "system")
    | dict.fromkeys(["query", "prompt", "input", "instruction", "question", "problem"], "query")
    | dict.fromkeys(["response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content"], "response")
)
ROLE_FIELDS, CONTENT_FIELDS = ("role", "from"), ("content", "value")
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "gpt", "bot")
CALL_ROLES, RESULT_ROLES = ("function_call",), ("function_response", "observation", "observations")
PAIRED = ["messages", "images", "videos", "audios", "tools", "objects"]
STANDARD = PAIRED + [f"{side}_{c}" for side in ("rejected", "positive", "negative") for c in PAIRED] + ["rejected_response", "label", "channel", "margin", "teacher_prompt", "chat_template_kwargs"]

MESSAGES = "array<struct<role: string, content: string>>"


def _items(df: DataFrame, name: str) -> Column:
    """A column of messages as an array of variants; null if it is none."""
    kind = df.schema[name].dataType
    whole = F.col(name) if isinstance(kind, VariantType) else lenient_json(F.col(name)) if isinstance(kind, StringType) else F.to_variant_object(name)
    return F.try_variant_get(whole, "$", "array<variant>")


def _field(item: Column, names: tuple[str, ...]) -> Column:
    """The last of the fields that is there, as text."""
    return F.coalesce(*(F.try_variant_get(item, f"$.{n}", "string") for n in reversed(names)))


def _has(item: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_variant_get(item, f"$.{n}", "variant") for n in names)).isNotNull()


def _message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _standard_role(role: Column, system_role: str) -> Column:
    plain = F.replace(role, F.lit("-"), F.lit("_"))
    return (
        F.when(role.isin(*USER_ROLES), "user").when(role.isin(*ASSISTANT_ROLES), "assistant").when(plain.isin(*CALL_ROLES), "tool_call")
        .when(plain.isin(*RESULT_ROLES), "tool_response").when(role == system_role, "system").otherwise(role)
    )


def standard_messages(items: Column, system: Column, system_role: str = "system") -> Column:
    """Standard messages from an array of variants; null where there are none.

    Messages have a role and content, under any of their names, or are pairs of a user's and an assistant's text (told by the
    first one).  A system text stands first, unless the conversation begins with one of its own.
    """
    first = F.get(items, 0)
    pairs = ~_has(first, ROLE_FIELDS) & ~_has(first, CONTENT_FIELDS)
    opened = F.when(system.isNotNull(), F.array(_message("system", system))).otherwise(F.array().cast(MESSAGES))
    both = F.flatten(F.transform(items, lambda x: F.array(_message("user", _field(x, USER_ROLES)), _message("assistant", _field(x, ASSISTANT_ROLES)))))
    each = F.transform(items, lambda x: _message(_standard_role(_field(x, ROLE_FIELDS), system_role), _field(x, CONTENT_FIELDS)))
    own = F.coalesce(_field(first, ROLE_FIELDS) == system_role, F.lit(False))
    return F.when(F.size(items) > 0, F.when(pairs, F.concat(opened, both)).when(own, each).otherwise(F.concat(opened, each)))


def message_rows(df: DataFrame, system_role: str = "system") -> DataFrame:
    """Rows of conversations with standard messages; rows without any drop out.  Rejected messages are put right likewise."""
    df = rename_columns(df, MESSAGE_COLUMNS | {system_role: "system"})
    system = F.col("system").cast("string") if "system" in df.columns else F.lit(None).cast("string")
    out = {"messages": standard_messages(_items(df, "messages"), system, system_role)}
    if "rejected_messages" in df.columns:
        out["rejected_messages"] = standard_messages(_items(df, "rejected_messages"), F.lit(None).cast("string"), system_role)
    return df.withColumns(out).where("messages is not null").drop("system")


def response_rows(df: DataFrame) -> DataFrame:
    """Rows of a query and a response, with earlier pairs (`history`: arrays, or a text of them) and a system text if there are, as messages; of a list of responses the first counts."""
    df = rename_columns(df, RESPONSE_COLUMNS)
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    response = text("response")
    if "response" in df.columns and isinstance(df.schema["response"].dataType, ArrayType):
        response = F.get("response", 0).cast("string")
    history = F.array().cast("array<array<string>>")
    if "history" in df.columns:
        said = F.try_variant_get(lenient_json(F.col("history")), "$", "array<array<string>>") if isinstance(df.schema["history"].dataType, StringType) else F.col("history").cast("array<array<string>>")
        history = F.coalesce(said, history)
    messages = from_query(text("query"), response, history, text("system"))
    return df.withColumn("messages", messages).drop("query", "response", "history", "system")


def alpaca_rows(df: DataFrame) -> DataFrame:
    """Rows of an instruction, its input and an output, as messages."""
    df = df.withColumn("query", alpaca_query(F.col("instruction"), F.col("input"))).drop("instruction", "input")
    if "output" in df.columns:  # it counts before a response of its own
        df = df.drop("response").withColumnRenamed("output", "response")
    return response_rows(df)


def class_rows(df: DataFrame) -> DataFrame:
    """Rows of a query and a class number; a label that is no number stops the job."""
    return response_rows(df).withColumn("label", F.col("label").cast("int"))


def auto_rows(df: DataFrame) -> DataFrame:
    """Rows in the form that the columns tell: conversations, else instructions with inputs, else queries with responses."""
    names = set(df.columns)
    if names & {"messages", "conversation", "conversations"}:
        return message_rows(df)
    return alpaca_rows(df) if {"instruction", "input"} <= names else response_rows(df)


def keep_standard(df: DataFrame) -> DataFrame:
    """The standard columns only."""
    return df.select(*(c for c in df.columns if c in STANDARD))
