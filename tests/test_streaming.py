"""Streams run to their end on small folders."""

from quillspark.streaming import jobs


def test_log_and_latest(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "id bigint, seq bigint, error boolean, score double"
    for k, rows in enumerate(([(1, 0, True, 0.0), (2, 0, False, 1.0)], [(1, 1, False, 5.0), (1, 0, False, 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = jobs.append_log(spark.readStream.schema(schema).parquet(src), log, str(tmp_path / "cp"))
        q.awaitTermination(60)
    got = {r.id: r.score for r in jobs.current(spark, log, "id", "seq").collect()}
    assert got == {1: 5.0, 2: 1.0}
    assert [r.id for r in jobs.pending(spark.range(1, 5), jobs.current(spark, log, "id", "seq"), "id").orderBy("id").collect()] == [3, 4]


def test_packing_carries_over_and_ends(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "shard bigint, id bigint, length bigint"
    rows = spark.createDataFrame([(i % 2, i, 3 + i % 4) for i in range(40)], schema)
    rows.repartition(4).write.parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.pack_stream(stream, 12).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(out).collect()

    seen = [i for p in run() for i in p.ids]
    assert len(seen) == len(set(seen)) and 0 < 40 - len(seen) <= 2 * 4  # each shard's open pack is still carried
    jobs.ends(rows).coalesce(1).write.mode("append").parquet(src)
    packs = run()
    assert sorted(i for p in packs for i in p.ids) == list(range(40)) and all(p.length <= 12 for p in packs)
    assert len({(p.shard, p.pack) for p in packs}) == len(packs)


def test_windows(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(src)
    q = jobs.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{src}/events.parquet").count()
