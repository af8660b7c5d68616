"""Overlap scores, delimiter parts and tool calls, rewards by name, and metrics with a state."""

import ast
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import checks, plugins, rule_rewards, toolcalls
from quillspark.operators import generation, metrics


def one(spark, column, **values):
    """A column's value for one row."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_is_that_of_the_whole_table():
    rnd = random.Random(1)
    for _ in range(400):
        k = rnd.choice([1, 2, 5, 50])
        a, b = ([rnd.randrange(k) for _ in range(rnd.randrange(90))] for _ in "ab")
        assert generation.lcs_length(a, b) == table_lcs(a, b)
    assert generation.lcs_length([], [1]) == 0 == generation.lcs_length([1], [])


def test_text_scores_by_hand(spark):
    rows = [
        ("the cat sat on the mat", "the cat sat on the mat"),
        ("the the the the the the the", "the cat is on the mat"),
        ("a b", "a c b d"),
        ("x y", "z"),
        ("", "z"),
        (None, "z"),
        ("a,b", "a , b"),
        ("我们在", "我 们 去"),
    ]
    got = generation.text_scores(spark.createDataFrame(rows, "hyp string, ref string"), "hyp", "ref").collect()
    same, many, short, none, *blank, signs, han = got
    assert same[2:5] == (1.0, 1.0, 1.0) and same.bleu_4 == pytest.approx(1.0)
    # two of seven words match; no pair does: 1/2 of one of 6, then 1/4 of 5, then 1/8 of 4
    assert many.rouge_1 == pytest.approx(2 * 2 / 13) and many.rouge_l == pytest.approx(2 * 2 / 13)
    assert many.bleu_4 == pytest.approx(math.exp((math.log(2 / 7) + math.log(1 / 2 / 6) + math.log(1 / 4 / 5) + math.log(1 / 8 / 4)) / 4))
    # both words match in order, the reference is twice as long; of orders beyond the text one n-gram counts
    assert short.rouge_l == pytest.approx(2 * 2 / 6) and short.rouge_2 == 0.0
    assert short.bleu_4 == pytest.approx(math.exp(1 - 4 / 2) * math.exp((math.log(1) + math.log(1 / 2) + math.log(1 / 4) + math.log(1 / 8)) / 4))
    assert tuple(none)[2:] == (0.0, 0.0, 0.0, 0.0)
    assert all(tuple(r)[2:] == (None,) * 4 for r in blank[:2])
    assert signs.rouge_l == 1.0 and han.rouge_1 == pytest.approx(2 / 3)
    mean = generation.mean_text_scores(spark.createDataFrame(rows, "hyp string, ref string"), "hyp", "ref").first()
    assert mean.pairs == 6 and mean.rouge_l == pytest.approx(100 * sum(r.rouge_l for r in got if r.rouge_l is not None) / 6, abs=1e-6)


PARTS = [("Action: a\nAction Input: {}\nObservation: ok", ["Action:", "Action Input:", "Observation:"]), ("before|x||y", ["|"]), ("", ["a"]), ("none here", ["zz"]), ("aXbXX", ["X"]), ("a.b*c", [".", "*"]), ("$1 \\d+ $", ["$", "\\d+"]), ("abc", [])]


@pytest.mark.parametrize(("text", "delimiters"), PARTS)
def test_literal_parts_are_kept_in_order(spark, text, delimiters):
    got = [tuple(p) for p in one(spark, toolcalls.split_parts(F.col("t"), delimiters), t=text)]
    pieces = re.split("|".join(f"({re.escape(d)})" for d in delimiters), text) if delimiters else [text]
    pieces = [p for p in pieces if p is not None]
    want = [("", pieces[0])] if pieces[0] else []
    want += [(pieces[i], pieces[i + 1]) for i in range(1, len(pieces), 2)]
    assert got == want and "".join(k + c for k, c in got) == text


def test_parts_at_patterns_are_entries_each(spark):
    text = "pre<think>\nso\n</think>mid<answer>4</answer>"
    got = [tuple(p) for p in one(spark, toolcalls.split_parts(F.col("t"), [r"<think>.*?</think>", r"<answer>"], True), t=text)]
    assert got == [("", "pre"), (r"<think>.*?</think>", "<think>\nso\n</think>"), ("", "mid"), ("<answer>", "<answer>"), ("", "4</answer>")]


def calls(spark, column, text):
    return [tuple(c) for c in one(spark, column, t=text)]


def test_calls_of_replies(spark):
    react = toolcalls.react_calls(F.col("t"))
    assert calls(spark, react, "I think\nAction: find \nAction Input: {\"q\": 1}\nObservation: x\nAction: go\nAction: stay\nObservation:\nAction Input: now") == [("find", '{"q": 1}'), ("go", "now")]
    assert calls(spark, react, "Action Input: x Action: y") == [] and calls(spark, react, "") == []
    tagged = toolcalls.tool_calls(F.col("t"))
    text = "<tool_call>{'name': 'a', 'arguments': {'x': True, 'y': None,}}</tool_call> <tool_call>\n{\"name\": \" b\", \"arguments\": \" [1, 2.5] \"}\n</tool_call><tool_call>{\"name\": \"c\"}</tool_call><tool_call>no</tool_call>"
    got = calls(spark, tagged, text)
    assert [c[0] for c in got] == ["a", "b"] and json.loads(got[0][1]) == {"x": True, "y": None} and got[1][1] == "[1, 2.5]"
    assert calls(spark, tagged, "<tool_call>broken</tool_call> Action: f Action Input: 3") == [("f", "3")]
    own = toolcalls.tool_calls(F.col("t"), ("Do:", "With:", "Saw:"))
    assert calls(spark, own, "Do: f With: 3 Saw: 4") == [("f", "3")] and calls(spark, own, "Action: f Action Input: 3") == [("f", "3")]


def test_calls_and_tools_as_text(spark):
    rows = spark.createDataFrame([('{"name": "f", "parameters": {"b": 1}}',), ("{'name': 'g', 'arguments': '{}'}",), ('{"name": "h"}',), ("[]",), ("f(1)",), (None,)], "t string")
    parsed = [r[0] and tuple(r[0]) for r in rows.select(toolcalls.parse_call(F.col("t"))).collect()]
    assert parsed == [("f", '{"b":1}'), ("g", "{}"), None, None, None, None]
    text = rows.limit(2).select(toolcalls.format_calls(F.array(toolcalls.parse_call(F.col("t"))))).collect()
    assert text[0][0] == 'Action: f\nAction Input: {"b":1}\nObservation:'
    assert calls(spark, toolcalls.react_calls(F.col("t")), text[0][0]) == [("f", '{"b":1}')]
    tools = spark.createDataFrame([('{"type": "function", "function": {"name": "a", "description": "d", "parameters": {"p": 1}}}',), ('{"name_for_model": "b", "description_for_model": "e"}',), ('{"name": "c"}',)], "t string")
    assert [r[0] and tuple(r[0]) for r in tools.select(toolcalls.parse_tool(F.col("t"))).collect()] == [("a", "d", '{"p":1}'), ("b", "e", "{}"), None]


def test_lenient_json_reads_what_either_parser_reads(spark):
    texts = ['{"a": [1, 2]}', "{'a': (1, 2)}", "True", "None", "{'a': 1,}", "nope", "", "__import__('os')", '"x"', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(F.to_json(toolcalls.lenient_json(F.col("t")))).collect()]

    def want(t):
        for parse in (json.loads, ast.literal_eval):
            try:
                return json.loads(json.dumps(parse(t)))
            except Exception:
                continue
        return "no value"

    assert ["no value" if g is None else json.loads(g) for g in got] == [want(t) for t in texts]


def test_readings_that_once_departed(spark):
    boxed = lambda t: one(spark, checks.boxed_answers(F.col("t")), t=t)
    assert boxed("\\boxed{1} then \\boxed{ {2") == ["1"] and boxed("\\boxed{ a{b}c } \\boxed{\\boxed{3}}") == ["a{b}c", "\\boxed{3}"] and boxed("} {") == []
    assert one(spark, checks.balanced_boxed(F.col("t")), t="\\boxed{1} then \\boxed{ {2") == "1"
    maps = lambda t: one(spark, checks.choices(F.col("t")), t=t)
    assert maps("It says (A) in text? (A) x (B) y") == {"A": "x", "B": "y"}
    assert maps("Which?\nA. one\nB)  two\n three\nc: 3") == {"A": "one", "B": "two three", "C": "3"} and maps("none") == {}
    reward = lambda t: one(spark, checks.reward_number(F.col("t")), t=t)
    assert (reward("Reward: 0.25"), reward("Reward: 7.5"), reward("Reward: -1"), reward("Reward:1"), reward("no")) == (0.25, None, None, 1.0, None)
    graded = lambda t: one(spark, checks.graded_reward(F.col("t")), t=t)
    assert (graded("**Reward:** -0.5**"), graded("Reward: 7.5 Reward: 1"), graded("Reward: high"), graded("none")) == (-0.5, 7.5, 0.0, 0.0)
    tags = lambda t, n: one(spark, checks.image_tags(F.col("t"), F.lit(n)), t=t)
    assert (tags("see", 2), tags("see", 0), tags("a < image >b<IMAGE>", 1), tags("a<image>b", 3)) == ("<image> <image>\nsee", "see", "a <image>b image ".replace("a <", "a <"), "<image> <image>\na<image>b")


def test_rule_rewards(spark):
    rows = spark.createDataFrame([("<think>a</think> <answer>1</answer>", "<think>x</think>\nAction: f\nAction Input: 1"), ("<think>a</think><answer>1</answer> more", "Action: f Action Input: 1"), (None, None)], "a string, b string")
    got = rows.select(rule_rewards.has_format(F.col("a")), rule_rewards.has_format(F.col("b"), rule_rewards.REACT_FORMAT)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    score = one(spark, rule_rewards.dapo(F.col("t"), F.lit(140), F.lit("4"), 150, 50, 2.0), t="Answer: 4")
    assert tuple(score) == (1.0 - 1.6, 1.0, -0.8, 1.0)
    action = rule_rewards.action_of(F.col("t"))
    both = lambda t: (one(spark, action["action"], t=t), one(spark, action["action_input"], t=t))
    assert both("Action: a Action Input: 1 Action: b Action Input: {2} ") == ("b", "{2}") and both("nothing") == ("none", "{}")
    assert one(spark, rule_rewards.first_boxed(F.col("t")), t="x \\boxed{ 1 } \\boxed{2}") == "1" and one(spark, rule_rewards.clean_latex(F.col("t")), t="\\(\\frac{1}{2}\\) ") == "\\frac12"


def test_rewards_by_name_and_from_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("Action: f Action Input: {\"a\": 1}\nObservation:", "Action: f Action Input: {\"a\": 1.0}", "1"), ("Action: f Action Input: {\"a\": 2}", "Action: f Action Input: {\"a\": 1}", "2"), ("Action: f Action Input: x", "Action: f Action Input: x", "0"), (None, "Action: none", "")], "said string, wanted string, digit string")
    out = plugins.with_reward(rows, plugins.REWARDS.get("tool_use"), F.col("said"), F.col("wanted"))
    out = plugins.with_reward(out, plugins.REWARDS.get("choice", letters="123"), F.col("said"), F.col("digit"))
    got = plugins.weighted(out, {"tool_use": 2.0, "choice": 1.0}).select("tool_use.overall", "choice.accuracy", "reward").collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 3.0), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 3.0)]
    file = tmp_path / "mine.py"
    file.write_text("REWARD_NAME = 'lengths'\nREWARD_TYPE = 'sequential'\nREWARD_OUTPUTS = ('overall', 'bonus')\nSCALE = 2\ndef half(x):\n    return x / SCALE\ndef score(row, plus=0.0):\n    out = {'overall': half(row['response_length'] or 0) + plus}\n    return out if row['ground_truth'] else {**out, 'bonus': 1.0}\n")
    own = plugins.load_reward(str(file), "score", plus=1.0)
    got = plugins.with_reward(rows, own, F.col("said"), F.col("digit"), F.lit(4)).select("lengths.*").collect()
    assert [tuple(r) for r in got] == [(3.0, None)] * 3 + [(3.0, 1.0)]
    assert plugins.describe(plugins.load_reward(str(file), "score")) == "lengths (sequential): overall, bonus; options plus"
    with pytest.raises(FileNotFoundError):
        plugins.load_reward(str(tmp_path / "none.py"), "score")
    with pytest.raises(AttributeError):
        plugins.load_reward(str(file), "other")
    with pytest.raises(KeyError):
        plugins.REWARDS.get("unknown")
    with pytest.raises(ValueError):
        plugins.Reward("x", len, "rows")


def test_metrics_over_hot_and_empty_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v")).repartition(5)
    got = {r.k: r for r in metrics.grouped_metric(rows, metrics.Moments("v"), "k", groups_at_once=100).collect()}
    want = {r.k: r for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most")).collect()}
    assert got.keys() == want.keys() and None in got
    for k, w in want.items():
        assert got[k].n == w.n and all(a == pytest.approx(b) for a, b in zip(got[k][2:], w[2:], strict=True))
    assert metrics.grouped_metric(rows.where("false"), metrics.Moments("v"), "k").count() == 0
    lists = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [6.0]), ("b", []), ("b", None)], "k string, x array<double>")
    assert {r.k: r.value for r in metrics.grouped_metric(lists, metrics.Mean("x", -1.0), "k").collect()} == {"a": 3.0, "b": -1.0}
