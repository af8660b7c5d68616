"""Rule rewards of a reply against the truth: column expressions, and two that need a parser, as rewards by name."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.checks import answer_reward
from quillspark.functions.labels import strip
from quillspark.functions.plugins import REWARDS, Row

# The forms that replies are asked to have, and marks that end them.
FORMAT = r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z"
REACT_FORMAT = r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$"
END_MARKS = ("<|endoftext|>", "<|im_end|>")
OBSERVATION = "Observation:"


def has_format(reply: Column, pattern: str = FORMAT) -> Column:
    """1 for a reply of the form, else 0."""
    return F.when(F.regexp_like(F.coalesce(reply, F.lit("")), F.lit(pattern)), 1.0).otherwise(0.0)


def dapo(reply: Column, length: Column, truth: Column, longest: int, buffer: int, factor: float = 1.0) -> Column:
    """overall, accuracy (1 or -1), overlong (from 0 down to -1 within the buffer before the longest length) and accuracy_normalized (1 or 0)."""
    accuracy = answer_reward(reply, truth)
    overlong = F.when(length <= longest - buffer, 0.0).when(length <= longest, (F.lit(longest - buffer) - length) / buffer).otherwise(-1.0)
    return F.struct((accuracy + overlong * factor).alias("overall"), accuracy.alias("accuracy"), overlong.alias("overlong"), (0.5 * (accuracy + 1.0)).alias("accuracy_normalized"))


def action_of(text: Column) -> dict[str, Column]:
    """The last action of a reply, up to the input that follows it (`none` without one), and the last input (`{}` without one)."""
    text = F.coalesce(text, F.lit(""))
    behind = F.substring_index(F.substring_index(text, "Action:", -1), "Action Input:", 1)
    return {"action": F.when(text.contains("Action:"), strip(behind)).otherwise("none"), "action_input": F.when(text.contains("Action Input:"), strip(F.substring_index(text, "Action Input:", -1))).otherwise("{}")}


def first_boxed(text: Column) -> Column:
    """What the first `\\boxed{` holds up to the next closing brace, or the text itself."""
    found = F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1))
    return F.coalesce(strip(F.try_element_at(found, F.lit(1))), text)


def clean_latex(text: Column) -> Column:
    """Without the marks of formulas and without braces."""
    return strip(F.translate(F.regexp_replace(text, r"\\\(|\\\)|\\\[|\\\]", ""), "{}", ""))


@REWARDS.add("choice", "batch", ("overall", "accuracy"))
def choice(rows: list[Row], letters: str = "012") -> list[dict[str, float]]:
    """1 where the first of the choices in the reply is the truth."""
    found = [re.search(f"[{letters}]", r["response"] or "") for r in rows]
    hits = [float((m[0] if m else "") == r["ground_truth"]) for m, r in zip(found, rows, strict=True)]
    return [{"overall": h, "accuracy": h} for h in hits]


def _last_action(text: str) -> tuple[str, str]:
    action = text.rpartition("Action:")[2].partition("Action Input:")[0].strip() if "Action:" in text else "none"
    return action, text.rpartition("Action Input:")[2].strip() if "Action Input:" in text else "{}"


@REWARDS.add("tool_use", "sequential")
def tool_use(row: Row) -> dict[str, float]:
    """1 where the reply's last action is that of the truth and the inputs are equal objects."""
    said = row["response"] or ""
    if said.endswith(OBSERVATION):
        said = said[: said.index(OBSERVATION)].strip()
    for mark in END_MARKS:
        said = said.replace(mark, "")
    (action, given), (wanted, asked) = _last_action(said.strip()), _last_action(row["ground_truth"] or "")
    try:
        given, asked = json.loads(given), json.loads(asked)
    except ValueError:
        return {"overall": 0.0}
    return {"overall": float(action == wanted and isinstance(given, dict) and isinstance(asked, dict) and given == asked)}
