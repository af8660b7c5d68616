"""Readers, specs, catalog, preprocessors."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import preprocessors as pre
from quillspark.sources import readers as rd


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "s": NaN}\n\nnot json\n{"a": 2, "s": -Infinity}\n')
    got = rd.read_jsonl(spark, str(p), "a int, s double").orderBy("a").collect()
    assert [r.a for r in got] == [1, 2] and got[0].s != got[0].s and got[1].s == float("-inf")
    with pytest.raises(Exception):
        rd.read_jsonl(spark, str(p), "a int, s double", strict=True).collect()
    assert rd.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_annotation_folder(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "y.json").write_text(json.dumps([{"a": 2}, {"a": 3}], indent=4))
    got = rd.read_annotations(spark, str(tmp_path), "a int").collect()
    assert sorted((r.a, r.source_annotation.rsplit("/", 1)[-1]) for r in got) == [(1, "x.jsonl"), (2, "y.json"), (3, "y.json")]
    assert rd.read_annotations(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b,c", 'q"q')], "x string, y string")
    rd.write_csv(df, str(tmp_path / "t.csv"), ["y", "x"])
    assert sorted(map(tuple, rd.read_table(spark, str(tmp_path / "t.csv")).select("x", "y").collect())) == sorted(map(tuple, df.collect()))
    rd.append(df, str(tmp_path / "t.json"))
    rd.append(df, str(tmp_path / "t.json"))
    assert rd.read_jsonl(spark, str(tmp_path / "t.json"), "x string, y string").count() == 4
    assert rd.markdown(df.limit(1)).count("\n") == 2
    assert spark.createDataFrame([("a\x07b",)], "t string").select(rd.without_control_characters(F.col("t"))).first()[0] == "ab"
    with pytest.raises(ValueError):
        rd.read_table(spark, "x.pkl")


def test_images(spark, tmp_path):
    (tmp_path / "p.jpg").write_bytes(b"abc")
    assert rd.read_images(spark, str(tmp_path / "*.jpg")).first().data_url == "data:image/jpeg;base64,YWJj"


@pytest.mark.parametrize("text, want", [("hf::a/b:x/y#20", ("hf", "a/b", ("x", "y"), 20)), ("name", (None, "name", (), None)), ("a#b#3", (None, "a#b", (), 3)), ("MS::n#5", ("ms", "n", (), 5)), ("s3://x/y#2", (None, "s3://x/y", (), 2))])
def test_specs(text, want):
    s = rd.parse_spec(text)
    assert (s.hub, s.name, s.subsets, s.rows) == want


def test_catalog(spark):
    c = rd.Catalog()
    c.register("n", lambda s: s.range(10), "id")
    with pytest.raises(ValueError):
        c.register("n", lambda s: s.range(1), "id")
    assert c.load(spark, "n").count() == 10 and c.load(spark, "n#4").distinct().count() == 4
    many = c.load(spark, "n#25").groupBy("id").count().collect()
    assert sum(r["count"] for r in many) == 25 and {r["count"] for r in many} == {2, 3}


def test_rename_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Prompt int, INPUT int, answer int")
    assert rd.rename_columns(df, {"prompt": "query", "input": "query", "answer": "response"}).columns == ["Prompt", "INPUT", "response"]


def test_preprocessors(spark):
    run = lambda name, rows, schema: pre.PREPROCESSORS[name](spark.createDataFrame(rows, schema)).collect()
    m = run("alpaca-zh", [("do", "输入：x", "y")], "instruction string, input string, output string")[0].messages
    assert [tuple(x) for x in m] == [("user", "do\nx"), ("assistant", "y")]
    assert run("dolly", [("i", "", "r")], "instruction string, context string, response string")[0].messages[0].content == "i"
    assert {(r.text, r.label) for r in run("hc3", [("q", ["h"], ["m"])], "question string, human_answers array<string>, chatgpt_answers array<string>")} == {("h", 0), ("m", 1)}
    hh = run("hh-rlhf", [("\n\nHuman: a\n\nAssistant: b", "\n\nHuman: a\n\nAssistant: c"), ("\n\nHuman: a\n\nAssistant: b", "\n\nHuman: a\n\nAssistant: b")], "chosen string, rejected string")
    assert len(hh) == 1 and hh[0].rejected_response == "c" and [x.role for x in hh[0].messages] == ["user", "assistant"]
    assert run("multi-hot", [([0, 1, 1],)], "labels array<int>")[0].label == [1, 2]
    assert len(run("stsb", [("a", "b", 0.9), ("a", "b", 0.1)], "sentence1 string, sentence2 string, score double")) == 1


def test_boxes(spark):
    df = spark.createDataFrame([([[5.0, 6.0, 1.0, 2.0], [3.0, 4.0], [1.0]],)], "b array<array<double>>")
    assert df.select(pre.boxes(F.col("b"))).first()[0] == [[1.0, 2.0, 5.0, 6.0], [3.0, 4.0], None]
    assert spark.createDataFrame([([1.0, 2.0],)], "b array<double>").select(pre.scaled(F.col("b"), F.lit(16.0), F.lit(800.0))).first()[0] == [62, 2]
