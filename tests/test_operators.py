"""Semantics of operators on literal edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers, labels, responses, texts
from quillspark.operators import advantages, conversations, evaluation, rewards, sampling, supervision


def value(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_labels_at_the_thresholds(spark):
    got = value(spark, [(0.125,), (0.126,), (0.75,), (0.875,), (None,)], "s double", labels.step_label(F.col("s")))
    assert got == [0, None, 1, 1, None]
    assert value(spark, [(0.8,)], "s double", labels.step_label(F.col("s"), high=labels.RL_TAU_POSITIVE, uncertain=-1)) == [-1]


def test_polarity(spark):
    df = spark.createDataFrame([([],), ([None, 0.1],), ([0.9, 0.8],), ([0.9, 0.1],), ([0.5],)], "s array<double>")
    got = df.select(*(c.alias(n) for n, c in labels.polarity(F.col("s")).items())).collect()
    assert [tuple(r) for r in got] == [(False,) * 5, (True, True, True, False, True), (False, False, False, True, True), (True, True, False, False, True), (False,) * 5]


def test_reject_reasons(spark):
    rows = [([],), ([None],), ([0.5, 1.0],), ([0.0, 1.0],)]
    assert value(spark, rows, "s array<double>", supervision.reject_reason(F.col("s"))) == ["missing_image_or_steps", "bad_score", "fuzzy_step", "ok"]


def test_numbered_steps(spark):
    got = value(spark, [(["a", " step 1: b", ""],)], "s array<string>", labels.numbered_steps(F.col("s"), placeholder=True))
    assert got == [["Step 0: a", "step 1: b", "Step 2: Step 2"]]
    assert value(spark, [([0, 1],), ([],)], "l array<int>", labels.previous_judgments(F.col("l"))) == ["Step 0: \\boxed{0}\nStep 1: \\boxed{1}", "None"]
    assert value(spark, [("\u00a0[Question] why ",)], "q string", labels.question(F.col("q"))) == ["why"]


def test_step_f1_counts_invalid_predictions_against_one_class(spark):
    rows = [("a", 1, 1), ("a", 1, -2), ("a", -1, -1), ("a", 0, 1), ("b", -1, 1)]
    got = {r.data_source: r for r in supervision.step_f1(spark.createDataFrame(rows, "data_source string, truth int, pred int")).collect()}
    assert got["a"].f1_positive == pytest.approx(2 / 3) and got["a"].f1_negative == 1.0 and got["a"].invalid_predictions == 1
    assert got["b"].macro_f1 == 0.0 and got[None].steps == 4


def test_quotas():
    assert supervision.even_quotas({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 4, "c": 4}
    assert supervision.even_quotas({"a": 5, "b": 5, "c": 5}, 7) == {"a": 3, "b": 2, "c": 2}
    assert supervision.even_quotas({"a": 5}, None) == {"a": 5}
    assert sum(supervision.even_quotas({"a": 2, "b": 3}, 99).values()) == 5


def test_best_of_n(spark):
    rows = [("x", 0, None), ("x", 1, float("nan")), ("x", 2, 1.0), ("x", 3, 1.0), ("x", 4, 9.0), ("y", 0, -math.inf)]
    got = {r["index"]: r.best_idx for r in evaluation.best_of_n(spark.createDataFrame(rows, "index string, candidate_idx int, score double"), 4).collect()}
    assert got == {"x": 2, "y": 0}


def test_majority_ties_go_to_the_first_seen(spark):
    rows = [("x", i, a) for i, a in enumerate("baab")]
    assert evaluation.majority_vote(spark.createDataFrame(rows, "index string, candidate_idx int, answer string"), 9).first().answer == "b"


def test_pass_at_k_beyond_the_candidates(spark):
    rows = [("x", 0, False), ("x", 1, True), ("y", 0, False)]
    got = {r.k: r.pass_at_k for r in evaluation.pass_at_k(spark.createDataFrame(rows, "index string, candidate_idx int, hit boolean"), [1, 2, 99]).collect()}
    assert got == {1: 0.0, 2: 0.5, 99: 0.5}


def test_short_series_stay(spark):
    rows = [("a", i, float(i)) for i in range(2)] + [("b", i, float(i)) for i in range(4)]
    got = sorted((r.m, r.s, r.smoothed) for r in evaluation.moving_average(spark.createDataFrame(rows, "m string, s int, v double"), "m", "s", "v", 2).collect())
    assert got == [("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 0.0), ("b", 1, 0.5), ("b", 2, 1.5), ("b", 3, 2.5)]


def test_summary_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("k", None)], "k string, v double")
    assert evaluation.numeric_summary(df, ["k"], "v", "x").first()[1:] == (0.0,) * 7


def test_order_statistics_of_large_and_small_groups(spark):
    rnd = random.Random(1)
    values = {"big": [round(rnd.gauss(0, 5), 1) for _ in range(9000)] + [3.0] * 4000, "small": [5.0, 1.0, 4.0], "one": [7.0], "hot": [2.0] * 2500}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("small", None)], "k string, v double")
    got = {r.k: r for r in evaluation.order_statistics(df, ["k"], "v", {"p50": "(n - 1) * 0.5", "p99": "(n - 1) * 0.99", "upper": "n div 2", "first": "0"}).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        at = lambda r, vs=vs: vs[math.floor(r)] + (vs[math.ceil(r)] - vs[math.floor(r)]) * (r - math.floor(r))
        want = [at((len(vs) - 1) * 0.5), at((len(vs) - 1) * 0.99), vs[len(vs) // 2], vs[0]]
        assert [got[k].p50, got[k].p99, got[k].upper, got[k].first] == pytest.approx(want), k
        assert got[k].n == len(vs)


def test_latest(spark):
    rows = [(1, 0, "a"), (1, 2, "c"), (1, 1, "b"), (2, 0, "z")]
    assert sorted(r.v for r in evaluation.latest_per_key(spark.createDataFrame(rows, "k int, s int, v string"), "k", "s").collect()) == ["c", "z"]


def test_answers(spark):
    said = [("so \\boxed{1} then \\boxed{3.14}",), ("Final answer: B) x\n",), ("first\n\n last  line \n",), ("",), (None,)]
    assert value(spark, said, "t string", answers.final_answer(F.col("t"))) == ["3.14", "B) x", "last line", "", ""]
    assert value(spark, [("3.14",), ("-2.7e3",), ("1,234",), ("none",)], "t string", answers.number(F.col("t"))) == [3.0, -2.0, 1234.0, None]
    assert value(spark, [("3.14",), ("7",)], "t string", answers.number(F.col("t"), "full")) == [3.14, 7.0]
    assert value(spark, [("(c)",), ("D. because",), ("cat",)], "t string", answers.letter(F.col("t"))) == ["C", "D", ""]
    both = [("3.14", "3.99"), ("A", "b"), ("Yes.", "yes"), ("", "x")]
    assert value(spark, both, "a string, b string", answers.is_correct(F.col("a"), F.col("b"))) == [True, False, True, False]


def test_advantages(spark):
    rows = [("g", 1, 1.0), ("g", 2, 3.0), ("one", 3, 5.0), ("same", 4, 2.0), ("same", 5, 2.0)]
    df = spark.createDataFrame(rows, "uid string, item int, reward double")
    grpo = {r.item: r.advantage for r in advantages.advantage(df, "grpo").collect()}
    assert grpo[2] == pytest.approx(1 / (math.sqrt(2) + 1e-6)) and grpo[3] == grpo[4] == 0.0
    assert {r.item: r.advantage for r in advantages.advantage(df, "rloo").collect()} == {1: -2.0, 2: 2.0, 3: None, 4: 0.0, 5: 0.0}
    assert {r.item for r in advantages.dynamic_sampling(df).collect()} == {1, 2}
    assert {r.item for r in advantages.online_filter(df, 2.0, 5.0).collect()} == set()
    best = {r.item: r.advantage for r in advantages.pass_k_advantage(df).collect()}
    assert best[1] == 0 and best[2] > 0 and best[3] == best[4] == best[5] == 0
    with pytest.raises(ValueError):
        advantages.estimator("grpo")(lambda r: r)


def test_returns_and_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [0.5, 0.5, 0.5], [1, 0, 1])], "r array<double>, v array<double>, m array<int>")
    assert df.select(advantages.discounted(F.col("r"), F.col("m"), 0.5)).first()[0] == [1.0, 4.0, 4.0]
    got = df.select(advantages.gae(F.col("r"), F.col("v"), F.col("m"), 1.0, 1.0)).first()[0]
    assert got == [1 + 0.5 - 0.5 + 3.5, 3.5, 3.5]


def test_importance_weights(spark):
    ratios = [(0.5,), (1.5,), (2.0,), (3.0,)]
    one = lambda mode: value(spark, ratios, "r double", advantages.importance(F.col("r"), F.col("r"), mode, 2.0))
    assert one("token_truncate") == [0.5, 1.5, 2.0, 2.0] and one("token_mask") == [0.5, 1.5, 2.0, 0.0]


def test_step_metrics_count_steps_that_nobody_asked_for(spark):
    def of(labels, preds):
        entries = [(k, v) for k, v in preds.items()]
        df = spark.createDataFrame([(labels, entries)], "labels array<int>, e array<struct<step:bigint,score:int>>")
        return rewards.step_metrics(df.select(rewards.list_counts(F.col("labels"), F.col("e")).alias("c")).select("c.*")).first().asDict()

    right = of([0, 1, -1], {0: 0, 1: 1, 2: 1})
    assert right["macro_f1"] == right["step"] == 1.0 and right["parsed_steps"] == 3.0
    extra = of([0, 1], {0: 0, 1: 1, 2: 0})  # one more 0: its F1 falls to 2/3, and the count to a half caps the rest
    assert extra["negative_f1"] == pytest.approx(2 / 3) and extra["count"] == extra["macro_f1"] == 0.5 and extra["raw_macro_f1"] == pytest.approx(5 / 6)
    absent = of([1, 1], {0: 1, 1: 1, 5: 0})  # no label of 0, but a 0 that nobody asked for
    assert absent["negative_f1"] == 0.0 and absent["raw_macro_f1"] == 0.5
    none = of([-1], {})
    assert none["step"] == 0.0 and none["count"] == 0.0 and none["missing_steps"] == 1.0
    half = of([0, 1], {1: 1})
    assert half["balanced_accuracy"] == 0.5 and half["pred_negative_ratio"] == 0.0 and half["count"] == 0.5


def test_responses(spark):
    said = [
        ("<think> a </think>\n<answer>Step 0: 1\n- step 1 => \\boxed{0}\n2) 1</answer>", 1.0, {0: 1, 1: 0, 2: 1}),
        ("<think></think><answer>[1, 0, 2, \"1\", true]</answer>", 0.5, {0: 1, 1: 0, 4: 1}),
        ('x <think>t</think> <answer>{"s1": 0, "2": 1, "b": 1}', 0.3, {}),
        ('<answer>{"s1": 0, "2": 1, "b": 1, "1": 1}</answer>', 0.55, {1: 0, 2: 1}),  # "s1" is the last key that names step 1
        ("<answer>[1, oops\n3: 0</answer>", 0.55, {3: 0}),
        ("", 0.0, {}),
        (None, 0.0, {}),
    ]
    df = spark.createDataFrame([(r,) for r, _, _ in said], "response string")
    b = responses.blocks(F.col("response"))
    got = df.select(b["format"].alias("f"), responses.last_of_each(responses.step_scores(b["answer"])).alias("e")).collect()
    for r, (_, fmt, scores) in zip(got, said, strict=True):
        assert r.f == pytest.approx(fmt) and {e.step: e.score for e in r.e} == scores
    declared = [("FirstError: 2", [1, 1, 0], 1.0), ("firsterror = -1", [1, 1], 1.0), ("FirstError: 5", [0], 0.0), ("none", [0], 0.0), ("FirstError: 1", [0, 0], 0.0)]
    df = spark.createDataFrame([(a, l) for a, l, _ in declared], "a string, labels array<int>")
    assert [r[0] for r in df.select(rewards.localize(responses.first_error(F.col("a")), F.col("labels"))).collect()] == [w for _, _, w in declared]


def test_text_rewards(spark):
    rows = spark.createDataFrame([("a a a a",), ("a",), (None,), ("b c b c b",)], "t string")
    assert [r.penalty for r in rewards.repetition_penalty(rows, "t", 2, -1.0).collect()] == [pytest.approx(-2 / 3), 0.0, 0.0, pytest.approx(-0.5)]
    assert value(spark, [(0,), (2000,)], "n int", rewards.cosine_length(F.col("n"), 2000, -1.0, 1.0)) == [1.0, -1.0]


def test_messages(spark):
    df = spark.createDataFrame([("q", "r", [["a", "b"], ["c", None]])], "q string, r string, h array<array<string>>")
    m = df.select(conversations.from_query(F.col("q"), F.col("r"), F.col("h")).alias("m"))
    assert [tuple(x) for x in m.first().m] == [("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "q"), ("assistant", "r")]
    assert m.select(conversations.valid(F.col("m"))).first()[0]
    assert [x.content for x in m.select(conversations.drop_last_reply(F.col("m"))).first()[0]] == ["a", "b", "c", "q"]
    assert value(spark, [("GPT",), ("human",), ("judge",)], "r string", conversations.canonical_role(F.col("r"))) == ["assistant", "user", "judge"]


def test_texts(spark):
    assert value(spark, [('{"Score": [1, 0.5, x]}',), ('{"Score": [1]}',), ("",), ('{"Score": [1, , NaN, -1]}',)], "t string", texts.parse_scores(F.col("t"), 3)) == [[1, 1, -2], [-2, -2, -2], [-2, -2, -2], [1, 0, 0]]
    assert value(spark, [("12.5%",), ("80",), ("0.5",)], "t string", texts.percent(F.col("t"))) == [0.125, 0.8, 0.5]
    assert value(spark, [("a<step split>b<step split> ",), ("a\r\n\r\nb",), ("a\nb\n\n",), ("so\nStep 1: x\ny\n- z",), (None,)], "t string", texts.split_steps(F.col("t"))) == [["a", "b"], ["a", "b"], ["a", "b"], ["so", "Step 1: x\ny", "- z"], []]
    cut = [("x" * 70 + ". " + "y" * 60,), ("x" * 70 + "\n" + "y" * 5 + "; " + "z" * 60,), ("x" * 130,), (" short ",), ("x" * 60 + "; " + "y" * 70,), (None,)]
    assert value(spark, cut, "t string", texts.truncate(F.col("t"), 100)) == ["x" * 70, "x" * 70, "x" * 100, "short", "x" * 60, ""]
    assert value(spark, [("sk-1234567890",), ("short",), ("",), (None,)], "t string", texts.redact(F.col("t"))) == ["sk-123***7890", "sh***", "", ""]
    assert value(spark, [("x <think> deep </think> y",)], "t string", texts.think_block(F.col("t"))) == ["deep"]


def test_sampling(spark):
    df = spark.range(10).toDF("id")
    by = [supervision.hash_order("1", "id"), F.col("id")]
    parts = sampling.numbered(df, by).select(sampling.chunk(F.col("position"), 10, 3).alias("p")).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in parts} == {0: 4, 1: 3, 2: 3}
    assert sampling.train_val(df, 0.01, by).where("part = 'val'").count() == 1
    assert sampling.train_val(df, 0, by).where("part = 'val'").count() == 0
    padded = sampling.pad_to_divisor(df, "id", 10, 4)
    assert padded.count() == 12 and padded.where("padding").count() == 2


def test_numbers_by_blocks_and_checked_union(spark):
    rows = spark.createDataFrame([(10**15,), (3,), (3,), (None,), (-5,)], "id bigint")
    assert sorted((r.id is not None, r.id or 0, r.p) for r in sampling.by_blocks(rows, "id", [], "p").collect()) == [(False, 0, 0), (True, -5, 1), (True, 3, 2), (True, 3, 3), (True, 10**15, 4)]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, w int")
    assert sorted(map(tuple, sampling.union_checked(a, b, "k").collect())) == [(1, "x", 5), (2, "y", 6)]
    for other in (b.where("k = 1"), b.withColumn("v", F.lit("x")), b.unionAll(b)):
        with pytest.raises(Exception):
            sampling.union_checked(a, other, "k").collect()


def test_islands_span_blocks(spark):
    rows = [(i, int(i in (3, 25_000))) for i in range(0, 30_000, 7)] + [(3, 1), (25_000, 1)]
    got = advantages.islands(spark.createDataFrame(rows, "pos int, label int"), "pos", F.col("label") == 1)
    assert {r.pos: r.island for r in got.where("pos in (0, 7, 24997, 25004)").collect()} == {0: 0, 7: 1, 24997: 1, 25004: 2}
