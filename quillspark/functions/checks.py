"""Checks and readings of teacher and judge replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.labels import strip
from quillspark.functions.responses import last_of_each, once
from quillspark.functions.toolcalls import split_parts

# How replies state scores and rewards.
SCORE_LIST = r'\{\s*"Score"\s*:\s*\[([^\]]*)\]\s*\}'
REWARD = r"Reward:\s*([0-1](?:\.\d+)?)"
PAREN_CHOICE = r"(?is)\(([A-I])\)\s*(.+?)(?=\s*\([A-I]\)\s*|\z)"
LINE_CHOICE = r"(?is)(?:^|\n)\s*([A-I])[\)\].:]\s*(.+?)(?=\n\s*[A-I][\)\].:]|\z)"
FIRST_PAREN = r"(?i)\([A-I]\)"
FIRST_LINE = r"(?i)(?:^|\n)\s*[A-I][\)\].:]\s+"
IMAGE_TAG = r"(?i)<\s*image\s*>"
TOO_MANY_TOKENS = r"(\d+)\s*>\s*(\d+)\s*-\s*(\d+)"


def strict_scores(reply: Column, labels: Column) -> Column:
    """The first reason against a teacher's score list, `ok` if none: it is missing, has an item that is no number or not 0 or 1, is of another length than the steps, or differs on a confident step (label not null), of which there must be one."""
    found = F.regexp_like(F.coalesce(reply, F.lit("")), F.lit(SCORE_LIST))
    items = F.filter(F.transform(F.split(F.regexp_extract(reply, SCORE_LIST, 1), ","), strip), lambda x: x != "")
    kinds = F.transform(items, lambda x: F.when(x.try_cast("double").isNull(), "bad_score_item").when(x.try_cast("double").isin(0.0, 1.0), "ok").otherwise("bad_score_value"))
    bad = F.try_element_at(F.filter(kinds, lambda k: k != "ok"), F.lit(1))
    differs = F.exists(F.zip_with(items, labels, lambda x, y: y.isNotNull() & (x.try_cast("double") != y)), lambda x: x)
    return (
        F.when(~found, "missing_score_json").when(bad.isNotNull(), bad).when(F.size(items) != F.size(labels), "score_length_mismatch")
        .when(~F.exists(labels, lambda y: y.isNotNull()), "no_confident_steps").when(differs, "score_mismatch").otherwise("ok")
    )


def thinking_reason(text: Column, least: int) -> Column:
    """The first reason against a thinking text, `ok` if none."""
    text = strip(F.coalesce(text, F.lit("")))
    return F.when(F.upper(text) == "READY", "is_ready").when(F.upper(text).contains("READY"), "contains_ready").when(F.length(text) < least, "too_short").otherwise("ok")


def token_score(text: Column) -> Column:
    """The first 0 or 1 of a reply, -2 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), "[01]", 0).try_cast("int"), F.lit(-2))


def reward_number(text: Column) -> Column:
    """The number from 0 to below 2 behind `Reward:` in a reward model's reply, null without one."""
    return F.regexp_extract(text, REWARD, 1).try_cast("double")


def graded_reward(text: Column) -> Column:
    """What stands between the first `Reward:` of a judge's reply and the next, without stars, as a number; 0 if it is none."""
    found = F.split(F.coalesce(text, F.lit("")), "Reward:", -1)
    return F.coalesce(F.replace(strip(F.try_element_at(found, F.lit(2))), F.lit("*"), F.lit("")).try_cast("double"), F.lit(0.0))


def choice_probability(log0: Column, log1: Column, hard: Column) -> Column:
    """The chance of a 1 from two log-probabilities; where one is missing the hard label if it is 0 or 1, else minus infinity."""
    top = F.greatest(log0, log1)
    both = log0.isNotNull() & log1.isNotNull()
    return F.when(both, F.exp(log1 - top) / (F.exp(log0 - top) + F.exp(log1 - top))).when(hard.isin(0, 1), hard.cast("double")).otherwise(float("-inf"))


def retry_tokens(error: Column) -> Column:
    """How many tokens a retry may ask for, by an error of the form `asked > most - given`: at least 1, null without one."""
    part = lambda k: F.regexp_extract(error, TOO_MANY_TOKENS, k).try_cast("bigint")
    return F.when(part(2).isNotNull() & part(3).isNotNull(), F.greatest(F.lit(1), part(2) - part(3)))


def boxed_answers(text: Column) -> Column:
    """What each `\\boxed{` holds up to the brace that closes it, in order, braces within matched and white space at the ends off; one that is never closed, and what follows it, is none.

    A state machine over the braces: depth, place, where the open one starts, and the spans found.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("start"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(s: Column, part: Column) -> Column:
        key, after = part["key"], s["at"] + F.length(part["key"])
        opens = (s["depth"] == 0) & (key == "\\boxed{")
        depth = F.when(opens, 1).when(s["depth"] == 0, 0).when(key == "}", s["depth"] - 1).when(key == "", s["depth"]).otherwise(s["depth"] + 1)
        closes = (s["depth"] == 1) & (key == "}")
        span = F.array(F.struct(s["start"].alias("start"), (s["at"] - s["start"]).alias("length")))
        return F.struct(depth.alias("depth"), (after + F.length(part["content"])).alias("at"), F.when(opens, after).otherwise(s["start"]).alias("start"), F.when(closes, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate(split_parts(F.coalesce(text, F.lit("")), ["\\boxed{", "{", "}"]), zero, step, lambda s: s["spans"])
    return F.transform(spans, lambda x: strip(F.substring(text, x["start"], x["length"])))


def balanced_boxed(text: Column) -> Column:
    """The last of boxed_answers(), null without one."""
    return F.try_element_at(boxed_answers(text), F.lit(-1))


def choices(question: Column) -> Column:
    """Letter -> text of choices in parentheses, `(A) this (B) that`, else at the starts of lines, `A. this`.

    Text before the first mark does not count, white space within a choice becomes one blank, and
    of one letter the last choice counts.
    """

    def found(text: Column, pattern: str, letter: int) -> Column:
        # a match, without white space, starts with its mark: the letter, of which the place is known, and a sign
        one = lambda x: F.struct(F.upper(F.substring(x, letter, 1)).alias("k"), F.regexp_replace(strip(F.substring(x, F.lit(letter + 2), F.length(x))), r"(?U)\s+", " ").alias("v"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: once(strip(x), one))

    def marked(text: Column) -> Column:
        at = lambda pattern: F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0))
        return F.substring(text, F.coalesce(F.least(at(FIRST_PAREN), at(FIRST_LINE)), F.lit(1)), F.length(text))

    pairs = lambda text: once(found(text, PAREN_CHOICE, 2), lambda p: F.when(F.size(p) > 0, p).otherwise(found(text, LINE_CHOICE, 1)))
    return F.map_from_entries(last_of_each(once(once(F.coalesce(question, F.lit("")), marked), pairs), "k"))


def image_tags(text: Column, images: Column) -> Column:
    """A text with as many image tags as there are images: the first stay, further ones become words, and missing ones stand before it on a line of their own."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, IMAGE_TAG, -1)
    marked = F.transform(parts, lambda x, i: F.concat(F.when(i == 0, "").when(i <= images, "<image>").otherwise(" image "), x))
    missing = images - (F.size(parts) - 1)
    return F.concat(F.when(missing > 0, F.concat(F.array_join(F.array_repeat(F.lit("<image>"), missing.cast("int")), " "), F.lit("\n"))).otherwise(""), F.array_join(marked, ""))


#: What an answer loses before it is compared, in this order (fixed values).
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
#: Words and marks that are taken out (fixed values).
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: TeX that is unwrapped or written out (fixed values); the order is fixed, since a root or fraction may stand in a wrapping that goes first.
REWRITES = [(r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}")]


def normalised_answer(answer: Column) -> Column:
    """A final answer without articles, units and TeX wrapping, fractions and roots written out, digits without commas."""
    out = F.substring_index(answer, "=", -1)
    for old, new in [*SUBSTITUTIONS, *((r, "") for r in REMOVED)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in REWRITES:
        out = F.regexp_replace(out, pattern, new)
    out = F.replace(out, F.lit("$"), F.lit(""))
    digits = F.replace(out, F.lit(","), F.lit(""))
    return strip(F.when(F.regexp_like(digits, F.lit("^[0-9]+$")), digits).otherwise(out))


def answer_reward(response: Column, truth: Column, last: int = 300) -> Column:
    """1 if the last `Answer:` line in the last characters of a response agrees with the truth, else -1."""
    said = F.try_element_at(F.regexp_extract_all(F.right(response, F.lit(last)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1))
    return F.when(normalised_answer(F.coalesce(said, F.lit("[INVALID]"))) == normalised_answer(truth), 1.0).otherwise(-1.0)
