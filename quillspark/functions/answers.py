"""Final answers of rollouts: extraction, cleaning, keys and correctness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.labels import strip

# How rollouts state their answers, choices and numbers.
BOXED = r"\\boxed\{([^{}]+)\}"
NAMED_ANSWER = r"(?is)(?:^|\n)\s*(?:final\s+)?answer\s*:\s*(.+?)\s*$"
LETTER_ALONE = r"(?i)^[\(\[\{]?\s*([A-I])\s*[\)\]\}]?\.?$"
LETTER_BEFORE = r"(?i)^\s*([A-I])\s*[\)\].:,-]\s+.+"
LETTER_MARKED = r"(?i)^([A-I])[)\].:,-]? ?\z"
NUMBER = r"[-+]?(?:\d+(?:,\d{3})*|\d*\.\d+)(?:[eE][-+]?\d+)?"


def cleanup(text: Column) -> Column:
    """Without an outer `\\boxed{}`, quotes at the ends, and runs of white space."""
    out = strip(F.coalesce(text, F.lit("")))
    out = strip(F.regexp_replace(out, r"^\\boxed\{(.+)\}$", "$1"))
    out = strip(F.regexp_replace(out, "^['\"`]+|['\"`]+$", ""))
    return F.regexp_replace(out, r"(?U)\s+", " ")


def final_answer(text: Column) -> Column:
    """The last boxed text, else what follows `answer:`, else the last line that is not blank."""
    text = strip(F.coalesce(text, F.lit("")))
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(BOXED), F.lit(1)), F.lit(-1))
    named = F.nullif(F.regexp_extract(text, NAMED_ANSWER, 1), F.lit(""))
    line = F.regexp_extract(text, r"([^\r\n]*)$", 1)
    return cleanup(F.coalesce(boxed, named, line))


def letter(answer: Column, mode: str = "reference") -> Column:
    """The choice letter of a cleaned answer, or an empty string.  By default a text may follow it, so that `A, the one` gives A; mode `marked` reads a letter with one mark behind it at most, and nothing else."""
    if mode == "marked":
        return F.upper(F.regexp_extract(answer, LETTER_MARKED, 1))
    alone = F.regexp_extract(answer, LETTER_ALONE, 1)
    before = F.regexp_extract(answer, LETTER_BEFORE, 1)
    return F.upper(F.when(alone != "", alone).otherwise(before))


def compact(answer: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(answer), "[^a-z0-9]+", "")


def number(answer: Column, mode: str = "reference") -> Column:
    """The first number.  By default digits are tried before a fraction, so that 3.14 gives 3; mode `full` reads fractions."""
    pattern = NUMBER if mode == "reference" else r"[-+]?(?:\d*\.\d+|\d+\.?)(?:[eE][-+]?\d+)?"
    return F.regexp_extract(F.replace(answer, F.lit(","), F.lit("")), pattern, 0).try_cast("double")


def keys(answer: Column) -> Column:
    """Keys under which an answer may agree with another: letter, text, number."""
    text, num = compact(answer), number(answer)
    all_keys = F.array(
        F.when(letter(answer) != "", F.concat(F.lit("letter:"), letter(answer))),
        F.when(text != "", F.concat(F.lit("text:"), text)),
        F.when(num.isNotNull(), F.concat(F.lit("num:"), num.cast("string"))),
    )
    return F.array_distinct(F.filter(all_keys, lambda x: x.isNotNull()))


def is_correct(answer: Column, reference: Column, tolerance: float = 1e-6) -> Column:
    """Whether keys meet, or numbers agree within a relative tolerance."""
    a, b = cleanup(answer), cleanup(reference)
    near = F.abs(number(a) - number(b)) <= tolerance * F.greatest(F.lit(1.0), F.abs(number(b)))
    return (a != "") & (b != "") & (F.arrays_overlap(keys(a), keys(b)) | F.coalesce(near, compact(a) == compact(b)))
