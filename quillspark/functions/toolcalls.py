"""Texts split at delimiters that are kept, and calls of tools in model replies, as column expressions.

JSON is read leniently: what is no JSON but a Python literal (single quotes, True, None,
trailing commas) counts as what it says.  Only such texts go through Python.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The keywords of replies that reason and act, and the tags around a call.
REACT = ("Action:", "Action Input:", "Observation:")
CALL_TAG = r"(?s)<tool_call>(.+?)</tool_call>"

CALLS = "array<struct<name: string, arguments: string>>"


def _literal(text: str) -> str:
    """A pattern for the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def split_parts(text: Column, delimiters: Sequence[str], regex: bool = False) -> Column:
    """(key, content) entries of a text split at delimiters, in order; their joined texts are the text.

    Literal: an entry is a delimiter and what follows it, and text before the first has the key
    ''.  With `regex`, delimiters are patterns (without groups of their own; `.` takes line ends too) and delimiters and
    what lies between are entries each, of which none is empty; a key is the first pattern that the
    content starts with, or ''.
    """
    entry = lambda key, content: F.struct(key.alias("key"), content.alias("content"))
    if not delimiters:
        return F.filter(F.array(entry(F.lit(""), text)), lambda e: e["content"] != "")
    patterns = [*delimiters] if regex else [_literal(d) for d in delimiters]
    pattern = "(?s)" + "|".join(f"(?:{p})" for p in patterns)
    keys = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pairs = F.arrays_zip(keys.alias("key"), F.split(text, pattern, -1).alias("content"))
    if not regex:
        return F.filter(F.transform(pairs, lambda p: entry(p["key"], p["content"])), lambda e: (e["key"] != "") | (e["content"] != ""))
    pieces = F.filter(F.flatten(F.transform(pairs, lambda p: F.array(p["key"], p["content"]))), lambda x: x != "")

    def key(piece: Column) -> Column:
        found = F.lit("")
        for p in reversed(patterns):
            found = F.when(F.regexp_like(piece, F.lit(f"(?s)^(?:{p})")), p).otherwise(found)
        return found

    return F.transform(pieces, lambda x: entry(key(x), x))


def react_calls(text: Column, action: str = REACT[0], action_input: str = REACT[1], observation: str = REACT[2]) -> Column:
    """Calls of a reply that names an action and its input: an action waits, through other parts, for the next input; further actions before it are passed over."""
    state = F.struct(F.lit(None).cast("string").alias("waits"), F.array().cast(CALLS).alias("calls"))
    blank = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def step(s: Column, part: Column) -> Column:
        begins = s["waits"].isNull() & (part["key"] == action)
        completes = s["waits"].isNotNull() & (part["key"] == action_input)
        call = F.array(F.struct(blank(s["waits"]).alias("name"), blank(part["content"]).alias("arguments")))
        return F.struct(F.when(begins, part["content"]).when(~completes, s["waits"]).alias("waits"), F.when(completes, F.concat(s["calls"], call)).otherwise(s["calls"]).alias("calls"))

    return F.aggregate(split_parts(F.coalesce(text, F.lit("")), [action, action_input, observation]), state, step, lambda s: s["calls"])


def _plain(text: str | None) -> str | None:
    """A Python literal as JSON, or None."""
    try:
        return json.dumps(ast.literal_eval(text), ensure_ascii=False) if text is not None else None
    except Exception:  # whatever a text may do to the parser, it is no literal
        return None


@F.pandas_udf(StringType())  # type objects: a text would need a session at import
def _from_literal(texts: pd.Series) -> pd.Series:
    return texts.map(_plain)


@F.pandas_udf(ArrayType(StringType()))
def _from_literals(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [_plain(t) for t in texts])


def lenient_json(text: Column) -> Column:
    """A variant of JSON or of a Python literal; null for neither."""
    strict = F.try_parse_json(text)
    return F.coalesce(strict, F.try_parse_json(_from_literal(F.when(strict.isNull(), text))))


def _argument(call: Column, *names: str) -> Column:
    """The first of the fields that is there, as text: a string as it is, anything else as JSON."""
    values = [F.try_variant_get(call, f"$.{n}", "variant") for n in names]
    value = F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in values))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def tagged_calls(text: Column, pattern: str = CALL_TAG) -> Column:
    """Calls between tags: objects with a name and arguments; others are passed over."""
    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    # only what strict JSON does not read goes to Python, at its own place
    odd = _from_literals(F.transform(bodies, lambda b: F.when(F.try_parse_json(b).isNull(), b)))
    read = F.zip_with(bodies, odd, lambda b, o: F.coalesce(F.try_parse_json(b), F.try_parse_json(o)))
    calls = F.transform(read, lambda v: F.struct(F.trim(F.try_variant_get(v, "$.name", "string")).alias("name"), F.trim(_argument(v, "arguments")).alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def tool_calls(text: Column, keywords: Sequence[str] = REACT) -> Column:
    """Calls between tags, else by the given keywords, else by the standard ones."""
    tagged, own = tagged_calls(text), react_calls(text, *keywords)
    out = F.when(F.size(tagged) > 0, tagged)
    if tuple(keywords) != REACT:
        return out.when(F.size(own) > 0, own).otherwise(react_calls(text))
    return out.otherwise(own)


def format_calls(calls: Column, keywords: Sequence[str] = REACT) -> Column:
    """Calls as a reply that names actions and their inputs, ended by the mark for what is observed."""
    lines = F.transform(calls, lambda c: F.concat(F.lit(f"{keywords[0]} "), c["name"], F.lit(f"\n{keywords[1]} "), c["arguments"], F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit(keywords[2]))


def parse_call(content: Column) -> Column:
    """(name, arguments) of one call that is an object, its arguments under that name or `parameters`; null if it has neither or is no object."""
    call = lenient_json(content)
    name, arguments = F.try_variant_get(call, "$.name", "string"), _argument(call, "arguments", "parameters")
    return F.when(name.isNotNull() & arguments.isNotNull(), F.struct(name.alias("name"), arguments.alias("arguments")))


def parse_tool(tool: Column) -> Column:
    """(name, description, parameters) of a tool described by JSON, wrapped as a function or not; null without a name or a description."""
    whole = lenient_json(tool)
    inner = F.coalesce(F.try_variant_get(whole, "$.function", "variant"), whole)
    one = lambda *names: F.coalesce(*(F.try_variant_get(inner, f"$.{n}", "string") for n in names))
    name, description = one("name_for_model", "name"), one("description", "description_for_model")
    parameters = F.coalesce(_argument(inner, "parameters"), F.lit("{}"))
    return F.when(name.isNotNull() & description.isNotNull(), F.struct(name.alias("name"), description.alias("description"), parameters.alias("parameters")))
