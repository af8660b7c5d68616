"""Datasets of several forms, resumed work, and progress of streams."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import checks
from quillspark.operators.evaluation import pending_rows
from quillspark.sources import standard
from quillspark.streaming import jobs, progress


def messages(df):
    return [[tuple(m) for m in r.messages] for r in df.collect()]


TALKS = {
    '[{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]': [("user", "a"), ("assistant", "b")],
    '[{"role": "system", "content": "s"}, {"role": "user", "content": "a"}]': [("system", "s"), ("user", "a")],
    "[{'user': 'a', 'assistant': None}, {'human': 'c', 'bot': 'd'}]": [("user", "a"), ("assistant", None), ("user", "c"), ("assistant", "d")],
    '[{"role": "function-call", "value": "f"}, {"role": "observation", "content": "o"}, {"role": "critic", "content": "x"}]': [("tool_call", "f"), ("tool_response", "o"), ("critic", "x")],
    '[{"role": "user", "from": "gpt", "content": "a", "value": "b"}]': [("assistant", "b")],
}


def test_conversations_in_many_forms(spark):
    df = spark.createDataFrame([(t, None) for t in [*TALKS, "[]", "no list", None]], "conversation string, keep int").coalesce(1)
    assert messages(standard.auto_rows(df)) == [*TALKS.values()]
    with_system = messages(standard.auto_rows(df.withColumn("system_prompt", F.lit("be brief"))))
    assert with_system == [m if m[0] == ("system", "s") else [("system", "be brief"), *m] for m in TALKS.values()]
    structs = spark.createDataFrame([([("human", "a"), ("bot", "b")],), ([],), (None,)], "messages array<struct<from: string, value: string>>")
    assert messages(standard.auto_rows(structs)) == [[("user", "a"), ("assistant", "b")]]
    maps = spark.createDataFrame([([{"role": "user", "content": "a"}, {"role": "assistant", "value": "b"}],)], "messages array<map<string, string>>")
    assert messages(standard.message_rows(maps)) == [[("user", "a"), ("assistant", "b")]]
    both = standard.message_rows(spark.createDataFrame([([*TALKS][0], [*TALKS][2])], "conversations string, rejected_messages string")).first()
    assert [tuple(m) for m in both.rejected_messages] == TALKS[[*TALKS][2]]


def test_queries_with_responses_and_instructions(spark):
    rows = spark.createDataFrame([("q", ["r", "other"], "[['a', 'b'], ['c', None]]", "s"), ("q", [], None, None), (None, None, "no pairs", None)], "prompt string, targets array<string>, history string, system string").coalesce(1)
    assert messages(standard.auto_rows(rows)) == [[("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "q"), ("assistant", "r")], [("user", "q")], []]
    # two columns that claim one name stay as they are
    twice = standard.response_rows(spark.createDataFrame([("q", "x", "y")], "query string, answer string, output string"))
    assert messages(twice) == [[("user", "q")]] and {"answer", "output"} <= set(twice.columns)
    alpaca = spark.createDataFrame([("do", "this", "done", 1), ("do", "", "done", 1), (None, "this", None, 1)], "instruction string, input string, output string, images int").coalesce(1)
    out = standard.auto_rows(alpaca)
    assert messages(out) == [[("user", "do\nthis"), ("assistant", "done")], [("user", "do"), ("assistant", "done")], [("user", "this")]]
    assert standard.keep_standard(out.withColumn("extra", F.lit(1)).withColumn("rejected_images", F.lit(1))).columns == ["images", "messages", "rejected_images"]
    classes = standard.class_rows(spark.createDataFrame([("q", "2")], "text string, label string")).first()
    assert classes.label == 2 and tuple(classes.messages[0]) == ("assistant", "q")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        standard.class_rows(spark.createDataFrame([("q", "two")], "text string, label string")).collect()


def test_results_that_count(spark):
    rows = spark.range(1, 8).withColumnRenamed("id", "k")
    results = spark.createDataFrame([(1, 0, "full", None, None), (2, 0, None, "", ""), (3, 0, "soft", None, None), (4, 0, "full", "e", None), (5, 0, "full", None, "p"), (6, 0, "full", None, None), (6, 1, "soft", None, None), (None, 0, "full", None, None)], "k bigint, n int, reward_mode string, error string, parse_error string")
    ids = lambda *flags: sorted(r.k for r in pending_rows(rows, results, "k", "n", *flags).collect())
    assert ids("full") == [3, 6, 7] and ids("full", True) == [3, 4, 6, 7] and ids("full", True, True) == [3, 4, 5, 6, 7] and ids("soft") == [1, 2, 4, 5, 7]
    errors = spark.createDataFrame([("asked 9000 > 8192 - 100",), ("5>3-7",), ("other",), (None,)], "e string")
    assert [r[0] for r in errors.select(checks.retry_tokens(F.col("e"))).collect()] == [8092, 1, None, None]


def test_progress_counts_the_rows_of_each_batch(spark, tmp_path):
    listener = progress.Progress("counted")
    spark.streams.addListener(listener)
    try:
        for n in (3, 5, 2):
            spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.bounded(spark, str(tmp_path / "in"), "id bigint")
        query = stream.writeStream.format("memory").queryName("counted").trigger(availableNow=True).start()
        query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        failing = stream.select(F.raise_error(F.lit("broken row")).cast("bigint")).writeStream.format("noop").queryName("counted").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken row"):
            failing.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.table(spark).where("error is null and input_rows > 0").orderBy("batch").collect()
    assert sorted(r.input_rows for r in rows) == [2, 3, 5] and [r.done for r in rows][-1] == 10
    assert listener.table(spark).where("error is not null").count() == 1


def test_open_packs_come_out_by_a_timer(spark, tmp_path):
    schema = "shard bigint, id bigint, length bigint"
    spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 5), (1, 4, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    packs = jobs.pack_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 12, patience_ms=300)
    query = packs.writeStream.format("memory").queryName("timed").start()
    try:
        for _ in range(30):
            rows = spark.table("timed").collect()
            if len(rows) == 3 or query.awaitTermination(1):
                break
    finally:
        query.stop()
    assert sorted((r.shard, r.pack, r.ids) for r in rows) == [(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [4])]
