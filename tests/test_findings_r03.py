"""Inputs on which the third round's findings showed."""

import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import checks, responses
from quillspark.llm import common, minhash
from quillspark.operators import rewards, sampling
from test_queries import rows


def agrees(spark, name, tables, tmp_path):
    """A query's rows on tables of (rows, schema) against its SQL."""
    con = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
    found = rows(got.columns, got.collect())
    assert found == rows([d[0] for d in want.description], want.fetchall())
    return found


def test_letter_of_an_answer_that_is_more_than_a_letter(spark, tmp_path):
    texts = ["A, eses ndnt.", "B. the", "C", "d)", "(E)", "F:", "A-", "ab", None, "G .", "x\ni."]
    found = agrees(spark, "answer_extract", {"conversations": ([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")}, tmp_path)
    assert sorted(r[3] for r in found) == sorted(["", "", "C", "D", "", "F", "A", "", "", "", "I"])


def test_readings_are_made_once(spark):
    """The entries of a long reply are read once, not once for each of its steps: seconds for 200 replies of 200 steps, where a reading for each step takes minutes."""
    reply = "<think>" + "because " * 400 + "</think><answer>" + "\n".join(f"Step {i}: {i % 2}" for i in [*range(200), *range(0, 200, 2)]) + "</answer>"
    df = spark.range(200).select(F.lit(reply).alias("response"), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: i % 2).alias("labels"))
    began = time.perf_counter()
    got = rewards.response_rewards(df).agg(F.min("macro_f1"), F.max("parsed_steps"), F.min("format")).first()
    assert tuple(got) == (1.0, 200.0, 1.0) and time.perf_counter() - began < 30


def test_blocks_at_odd_tags(spark):
    nbsp = " "
    said = [
        ("\n<THINK> a </Think> \n <Answer>b</ANSWER> ", ("a", "b", 1.0)),
        ("<think>a</think> x <answer>b</answer>", ("a", "b", 0.8)),
        ("<think>a</think><answer>b</answer><answer>c</answer>", ("a", "b</answer><answer>c", 1.0)),
        ("<think>a</think>b</think><answer></answer>", ("a</think>b", "", 0.5)),
        ("</think><think>a <answer>b</answer>", ("", "b", 0.55)),
        ("</think><answer>b</answer><think>a</think>", ("a", "b", 0.8)),
        ("<think></answer>", ("", "", 0.3)),
        ("<think>a<think>b</think>", ("a<think>b", "", 0.45)),
        (f"{nbsp} <think>{nbsp}a{nbsp}</think><answer>b</answer>", ("a", "b", 1.0)),
    ]
    df = spark.createDataFrame([(r,) for r, _ in said], "response string")
    got = [(r.think, r.answer, round(r.format, 9)) for r in df.select(F.inline(F.array(responses.read_blocks(F.col("response"))))).collect()]
    assert got == [w for _, w in said]


def test_choices_of_a_long_question(spark):
    """Each choice is read once: of many marks, those of one letter leave the last."""
    text = "Which?\n" + " ".join(f"({'abC'[i % 3]})  this\n is {i}" for i in range(600))
    lines = "".join(f"\n {'abC'[i % 3]}{'.:)'[i % 3]}   this is \u00a0 {i}" for i in range(600))
    df = spark.createDataFrame([(text,), (lines,), ("none",), (None,), ("(A)(B) x (c)",)], "q string")
    began = time.perf_counter()
    got = [r.m for r in df.select(checks.choices(F.col("q")).alias("m")).collect()]
    assert got[:4] == [{"A": "this is 597", "B": "this is 598", "C": "this is 599"}] * 2 + [{}, {}] and time.perf_counter() - began < 20
    assert got[4] == {"A": "(B) x"}


def test_overlap_of_turns_that_recur(spark, tmp_path):
    said = [(1, 1, "a b B c"), (1, 2, "b b  d"), (1, 2, "A"), (1, 3, None), (1, 4, "x"), (1, 4, "x x"), (1, 5, "X y"), (2, 1, ""), (2, 2, "z"), (3, 7, "q q q"), (3, 8, "q q"), (4, 1, "alone"), (None, 1, "n"), (None, 2, "n")]
    schema = "conv_id long, turn int, role string, text string"
    agrees(spark, "rouge_unigrams", {"conversations": ([(c, t, "user", x) for c, t, x in said], schema)}, tmp_path)


def test_overlap_makes_no_row_of_a_word(spark):
    """Words stay in their row, and the parts of the one shuffle grow with the table."""
    plan = entry.queries()["rouge_unigrams"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_likely_keeps_every_key_and_little_else(spark):
    rows = spark.range(-50_000, 50_000, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionAll(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    keys = spark.range(-50_000, 50_000, 97).select(F.col("id").alias("doc_id"))
    got = common.likely(rows, keys, "doc_id")
    assert got.columns == ["doc_id", "text"] and got.join(keys, "doc_id").count() == keys.count() <= got.count() < keys.count() + 50
    assert common.likely(rows, keys.limit(0), "doc_id").count() == 0


def test_places_take_one_pass(spark):
    """Count and quantiles of the order are one job over the rows, and ties, nulls and NaN keep their places."""
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).otherwise(float("nan"))).alias("v"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    placed = sampling.by_blocks(rows.mapInArrow(counted, rows.schema), "v", ["id"], "place")
    assert seen.value == 30_000
    got = [r.id for r in placed.orderBy("place").collect()]
    assert got == [r.id for r in rows.orderBy(F.col("v").asc_nulls_first(), "id").collect()] and [r.place for r in placed.orderBy("place").collect()] == [*range(30_000)]


def test_near_copies_are_confirmed_without_moving_texts(spark, monkeypatch):
    """A semi join behind the filter was moved below it, and every text was shuffled."""
    plans, save = {}, minhash.save

    def saved(df, name, codec=None):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, name, codec)

    monkeypatch.setattr(minhash, "save", saved)
    said = [(k, " ".join(f"w{k // 2}x{j}" for j in range(40)) + (" end" if k % 2 else "")) for k in range(12)]
    rows = [*said, (0, said[6][1]), (30, None), (None, said[2][1]), (31, ""), (32, said[4][1])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert "LeftSemi" not in plans["sets"] and plans["sets"].count("Join") == 1
    # doc_id 0 has two texts, which connect the pairs (0, 1) and (6, 7); 32 is 4 again
    least = {0: 0, 1: 0, 6: 0, 7: 0, 32: 4, 30: 30, 31: 31, None: None} | {k: k - k % 2 for k in (2, 3, 4, 5, 8, 9, 10, 11)}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(k), str(least[k])) for k, _ in rows)
