"""Labels of steps from Monte-Carlo scores, and texts of steps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three encodings that must not be mixed.
SFT_UNCERTAIN = None  # {0, 1, null}
RL_UNCERTAIN = -1  # {0, 1, -1}
BENCHMARK_NEUTRAL = 0  # {1, 0, -1}; a prediction may also be -2 (invalid)

#: Thresholds, both inclusive.
TAU_NEGATIVE, TAU_POSITIVE, RL_TAU_POSITIVE = 0.125, 0.75, 0.875


def step_label(score: Column, low: float = TAU_NEGATIVE, high: float = TAU_POSITIVE, uncertain: int | None = SFT_UNCERTAIN) -> Column:
    """0 up to `low`, 1 from `high`, else (and for a null score) the given value."""
    return F.when(score <= low, F.lit(0)).when(score >= high, F.lit(1)).otherwise(F.lit(uncertain).cast("int"))


def polarity(scores: Column, low: float = TAU_NEGATIVE, high: float = TAU_POSITIVE) -> dict[str, Column]:
    """Whether a list of scores is selected by each polarity; null scores are passed over, and an empty list is not selected."""
    known = F.filter(scores, lambda x: x.isNotNull())
    some = F.size(known) > 0
    return {
        "negative_any": F.exists(known, lambda x: x <= low),
        "negative_final": F.coalesce(F.try_element_at(known, F.lit(-1)) <= low, F.lit(False)),
        "negative_all": some & F.forall(known, lambda x: x <= low),
        "positive": some & F.forall(known, lambda x: x >= high),
        "confident": F.exists(known, lambda x: (x <= low) | (x >= high)),
    }


#: White space by Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode; what lies between is not searched."""
    return F.trim(text, F.lit(BLANKS))


def question(text: Column) -> Column:
    """Without one leading `[Question]` mark."""
    return strip(F.regexp_replace(strip(text), r"^\[Question\]", ""))


def numbered_steps(steps: Column, placeholder: bool = False) -> Column:
    """`Step i: text`, unless a text starts so already; an empty text becomes `Step i` where placeholders are wanted."""

    def one(x: Column, i: Column) -> Column:
        mark = F.concat(F.lit("Step "), i.cast("string"))
        text = strip(F.coalesce(x, F.lit("")))
        if placeholder:
            text = F.when(text == "", mark).otherwise(text)
        return F.when(F.lower(text).startswith(F.lower(F.concat(mark, F.lit(":")))), text).otherwise(F.concat(mark, F.lit(": "), text))

    return F.transform(steps, one)


def previous_judgments(labels: Column) -> Column:
    """The text that lists earlier judgments, or `None`."""
    lines = F.transform(labels, lambda x, i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": \\boxed{"), x.cast("string"), F.lit("}")))
    return F.when(F.size(labels) > 0, F.array_join(lines, "\n")).otherwise(F.lit("None"))
