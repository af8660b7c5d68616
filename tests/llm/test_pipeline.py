"""The pipeline: each stage's columns and decisions, and the whole of it on the smallest tables."""

import collections
import random
import zlib

import pytest
from test_training_data import SCHEMA, brute_components, corpus, same, words

import corpus_pipeline
from quillspark.llm import quality_rules
from quillspark.llm.common import save, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = save(stage(spark, docs, DIR), "test")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
            assert sizes[-1] <= sizes[-2]
    assert sizes[3] > 0.5 * sizes[0]
    assert docs.agg({"length": "max"}).first()[0] <= 2048
    placed = docs.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n")
    assert placed.where("n > 2048").count() == 0


#: Names that the operators use themselves.
CLASHING = ["kept", "kept_text", "n_removed", "_row", "_gone", "_salt", "place", "quality", "_order", "component_id"]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and very long texts, ties, repeated rows, several texts of one doc_id, clashing names."""
    rows = [(*r, *CLASHING) for r in corpus()]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder whose labels teach nothing about these documents."""
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_classifier_without_labels_keeps_all(spark, hostile, labelled):
    got = corpus_pipeline.classify(spark, hostile, labelled)
    assert got.columns == hostile.columns
    same(got.collect(), hostile.collect())


def test_classifier_drops_what_labels_call_bad(spark, hostile, tmp_path):
    rnd = random.Random(3)
    rows = [(1000 + i, " ".join(rnd.choice(["$$$", "BUY###"] if i % 2 else ["alpha", "beta", "of"]) for _ in range(60)), "en", "s", 0, "", "", "", "", *CLASHING) for i in range(80)]
    table_ = hostile.unionByName(spark.createDataFrame(rows, hostile.schema))
    spark.createDataFrame([(r[0], 1 - (r[0] % 2)) for r in rows], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.classify(spark, table_, str(tmp_path)).where("doc_id >= 1000")
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows if r[0] % 2 == 0}


def test_rules_stage(spark, hostile, labelled):
    def passes(text):
        w = words(text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(again) <= 30 * len(w)

    got = corpus_pipeline.rules(spark, hostile, labelled)
    assert got.columns == hostile.columns
    same(got.collect(), [r for r in hostile.collect() if passes(r.text)])


def test_near_dedup_stage(spark, hostile, labelled):
    rows = corpus()
    got = corpus_pipeline.near_dedup(spark, hostile, labelled)
    assert got.columns == hostile.columns
    kept = {d for d, _, component, _ in brute_components(rows, 5) if d == component}
    left = {(r[0], r[1]) for r in rows if r[0] is None or r[0] in kept}
    same(got.select("doc_id", "text").collect(), left)


def test_substring_stage(spark, hostile, labelled):
    rows = corpus()
    seen = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
        want.append((r[0], text, r[2], r[3], len(text) if gone else r[4], *r[5:], *CLASHING))
    got = corpus_pipeline.substring_dedup(spark, hostile, labelled)
    assert got.columns == hostile.columns
    same(got.collect(), want)


def test_packing_stage(spark, hostile, labelled):
    got = corpus_pipeline.pack(spark, hostile, labelled).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and 1 <= r.length <= 2048
            at += r.length
        assert at <= 2048
    first = collections.Counter(r.doc_id for r in got if r.piece == 0)
    assert first == collections.Counter(r[0] for r in corpus())
    assert {(r.length, r.ids_crc32) for r in got if r.doc_id == 3} == {(1, zlib.crc32(bytes(4)))}


def test_stages_on_an_empty_table(spark, hostile, labelled):
    nothing = hostile.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, nothing, labelled)
        assert got.count() == 0, name
        assert k == 4 or got.columns == hostile.columns, name


def test_rules_without_labels_are_none(spark, hostile, labelled):
    assert quality_rules.fit(hostile, table(spark, labelled, "labels")) == []


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
