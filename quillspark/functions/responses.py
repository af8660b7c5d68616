"""Blocks, step scores and declarations of model responses, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.labels import strip

# The tags and lines that responses are asked to have.
THINK, THINK_END, ANSWER, ANSWER_END = "(?i)<think>", "(?i)</think>", "(?i)<answer>", "(?i)</answer>"
BETWEEN = r"(?i)</think>(?U:\s*)<answer>"
STEP_LINE = r"(?i)(?:^|\n)[ \t]*(?:[-*][ \t]*)?(?:Step[ \t]*)?(\d+)[ \t]*(?:[:.)\-]|=>|[ \t])[ \t]*(?:\\boxed\{)?[ \t]*([01])[ \t]*(?:\})?"
FIRST_ERROR = r"(?i)FirstError\s*[:=]\s*(-?\d+)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _between(text: Column, start: str, end: str) -> Column:
    """What stands behind the first start mark up to the next end mark, or an empty string."""
    inner = F.split(F.coalesce(F.get(F.split(text, start, 2), F.lit(1)), F.lit("")), end, 2)
    return once(inner, lambda x: F.when(F.size(x) == 2, strip(F.get(x, F.lit(0)))).otherwise(""))


def blocks(response: Column) -> dict[str, Column]:
    """The fields of read_blocks()."""
    return {c: read_blocks(response)[c] for c in ("think", "answer", "format")}


def read_blocks(response: Column) -> Column:
    """A struct of think, answer and the format score: 1 (or 0.5 if one is empty) for exactly the two blocks, else the sum for parts that are there, 0.8 at most.

    Texts are split at the tags, each of which is found by one search.
    """

    def exact(x: Column) -> Column:
        # the two blocks and nothing else: the text without its outer tags, split where one ends and the other starts
        whole = F.regexp_like(F.left(x["text"], F.lit(7)), F.lit(THINK)) & F.regexp_like(F.right(x["text"], F.lit(9)), F.lit(ANSWER_END))
        return F.when(whole, F.split(F.substring(x["text"], F.lit(8), F.length(x["text"]) - 16), BETWEEN, 2))

    def read(x: Column) -> Column:
        strict = F.coalesce(F.size(x["parts"]) == 2, F.lit(False))
        part = lambda i, start, end: F.when(strict, strip(F.get(x["parts"], F.lit(i)))).otherwise(_between(x["all"], start, end))
        return F.struct(strict.alias("strict"), part(0, THINK, THINK_END).alias("think"), part(1, ANSWER, ANSWER_END).alias("answer"), x["text"].startswith("<think>").alias("opens"), (~strict & F.regexp_like(x["all"], F.lit(ANSWER_END))).alias("ends"))

    def score(x: Column) -> Column:
        worth = lambda test, points: F.when(test, points).otherwise(0.0)
        parts = worth(x["think"] != "", 0.30) + worth(x["answer"] != "", 0.40) + worth(x["opens"], 0.15) + worth(x["ends"], 0.15)
        form = F.when(x["strict"], F.when((x["think"] != "") & (x["answer"] != ""), 1.0).otherwise(0.5)).otherwise(F.least(parts, F.lit(0.8)))
        return F.struct(x["think"].alias("think"), x["answer"].alias("answer"), form.alias("format"))

    text = once(F.coalesce(response, F.lit("")), lambda t: F.struct(t.alias("all"), strip(t).alias("text")))
    parts = once(text, lambda x: F.struct(x["all"].alias("all"), x["text"].alias("text"), exact(x).alias("parts")))
    return once(once(parts, read), score)


def step_scores(answer: Column) -> Column:
    """(step, score) entries with scores of 0 and 1: from a JSON list, a JSON object (numbers in its keys) or lines; of one step the last counts (of an object's keys, the last in order)."""
    entry = lambda i, v: F.struct(i.try_cast("bigint").alias("step"), v.cast("int").alias("score"))
    # a string is no score, even "1"
    score = lambda v: once(F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", "double")), lambda x: F.when(x.isin(0.0, 1.0), x))

    def of_json(x: Column) -> Column:
        listed = F.when(x["text"].startswith("["), x["json"].try_cast("array<variant>"))
        named = F.when(x["text"].startswith("{"), x["json"].try_cast("map<string, variant>"))
        return F.coalesce(F.transform(listed, lambda v, i: entry(i, score(v))), F.transform(F.map_entries(named), lambda e: entry(F.regexp_extract(e["key"], r"\d+", 0), score(e["value"]))))

    structured = once(strip(answer), lambda t: F.when(t.startswith("[") | t.startswith("{"), once(F.struct(t.alias("text"), F.try_parse_json(t).alias("json")), of_json)))
    lines = F.arrays_zip(F.regexp_extract_all(answer, F.lit(STEP_LINE), F.lit(1)).alias("i"), F.regexp_extract_all(answer, F.lit(STEP_LINE), F.lit(2)).alias("v"))
    return F.filter(F.coalesce(structured, F.transform(lines, lambda e: entry(e["i"], e["v"]))), lambda e: e["step"].isNotNull() & e["score"].isNotNull())


def last_of_each(entries: Column, key: str = "step") -> Column:
    """Entries without those that a later one of the same key replaces: in the order of key and place an entry stays if the next has another key, and those that stay go back to their places."""
    numbered = F.array_sort(F.transform(entries, lambda e, i: F.struct(e[key].alias("key"), i.alias("at"), e.alias("entry"))))
    kept = once(numbered, lambda x: F.filter(x, lambda e, i: ~e["key"].eqNullSafe(F.get(x, i + 1)["key"]) | (i + 1 == F.size(x))))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["entry"].alias("entry")))), lambda e: e["entry"])


def first_error(answer: Column) -> Column:
    """The declared first error, or null."""
    return F.regexp_extract(F.coalesce(answer, F.lit("")), FIRST_ERROR, 1).try_cast("bigint")
