"""Texts of rollouts and replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.checks import SCORE_LIST
from quillspark.functions.labels import strip

_BLANK = r"^[ \t\r\n]+|[ \t\r\n]+$"


def trim(text: Column) -> Column:
    """Without blanks and line ends at either end."""
    return F.regexp_replace(text, _BLANK, "")


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: trim(x) != "")


def normalise_thinking(text: Column) -> Column:
    """Without think tags, outer white space, and more than one empty line together."""
    return trim(F.regexp_replace(F.regexp_replace(text, r"</?think>", ""), r"\n{3,}", "\n\n"))


def think_block(text: Column) -> Column:
    """What stands between think tags."""
    return trim(F.regexp_extract(text, r"<think>([\s\S]*?)</think>", 1))


def split_steps(text: Column, mark: str = "<step split>") -> Column:
    """Steps of a response: by the mark, else by empty lines, else before lines that begin a step or an item, else by lines; blank ones drop out."""
    text = strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    # fixed values: how steps and items begin
    by_blank, by_start = F.split(text, r"\n\s*\n+"), F.split(text, r"\n(?=(?:Step\s*\d+|步骤\s*\d+|[-*]\s+))")
    parts = F.when(text.contains(mark), F.split(text, mark)).when(F.size(by_blank) > 1, by_blank).when(F.size(by_start) > 1, by_start).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def truncate(text: Column, limit: int) -> Column:
    """Up to `limit` characters, cut before the last blank line, line end, full stop or semicolon (in this order) that lies from 60 % of them on."""
    text = strip(F.coalesce(text, F.lit("")))
    head = F.substring(text, 1, limit)
    out = F.when(F.length(text) <= limit, text)
    for mark in ("\n\n", "\n", ". ", "; "):  # fixed values
        at = limit - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1  # characters before the last one
        out = out.when(head.contains(mark) & (at >= int(0.6 * limit)), _right_strip(F.substring(head, F.lit(1), at)))
    return out.otherwise(_right_strip(head))


def _right_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def parse_scores(reply: Column, expected: int) -> Column:
    """0 or 1 for each number of a `{"Score": [...]}` reply, blank items apart; -2 for what is none, and for all if there are too few or many."""
    inner = F.regexp_extract(F.coalesce(reply, F.lit("")), SCORE_LIST, 1)
    items = F.filter(F.transform(F.split(inner, ","), strip), lambda x: x != "")
    number = lambda x: x.try_cast("double")
    parts = F.transform(items, lambda x: F.when(number(x).isNull(), -2).when((number(x) > 0) & ~F.isnan(number(x)), 1).otherwise(0))
    return F.when(F.size(parts) == expected, parts).otherwise(F.array_repeat(F.lit(-2), expected))


def shared_words(a: Column, b: Column, times_a: Column, times_b: Column) -> Column:
    """How many words two lists share, each as often as the list that has it less often, when a list counts a number of times.

    One pass over both lists' words in order, with the counts of the word at hand.
    """
    zero = F.lit(0).cast("bigint")
    side = lambda words, in_a: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(in_a).cast("bigint").alias("a")))
    done = lambda s: s["shared"] + F.least(s["a"] * times_a, s["b"] * times_b)

    def step(s: Column, x: Column) -> Column:
        same = x["w"] == s["w"]
        before = lambda n: F.when(same, n).otherwise(zero)
        return F.struct(x["w"].alias("w"), (before(s["a"]) + x["a"]).alias("a"), (before(s["b"]) + 1 - x["a"]).alias("b"), F.when(same, s["shared"]).otherwise(done(s)).alias("shared"))

    start = F.struct(F.lit("").alias("w"), zero.alias("a"), zero.alias("b"), zero.alias("shared"))
    return F.aggregate(F.array_sort(F.concat(side(a, 1), side(b, 0))), start, step, done)


def redact(text: Column) -> Column:
    """Both ends of a secret: six and four characters, or the first two of one that has ten at most; nothing of an empty one."""
    long = F.concat(F.left(text, F.lit(6)), F.lit("***"), F.right(text, F.lit(4)))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.length(text) <= 10, F.concat(F.left(text, F.lit(2)), F.lit("***"))).otherwise(long)


def percent(text: Column) -> Column:
    """A share from `12.5%`, `12.5` or `0.125`."""
    value = F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    return F.when(text.contains("%") | (value > 1), value / 100).otherwise(value)
