"""Batches filled over tries, across restarts and in pieces."""

import pytest

from quillspark.streaming import batches

SCHEMA = "batch string, try_no int, of int, uid string, sample bigint, score double"


@pytest.fixture
def store(spark):
    before = spark.conf.get(batches.STATE_STORE[0], None)
    spark.conf.set(*batches.STATE_STORE)
    yield spark
    spark.conf.set(batches.STATE_STORE[0], before) if before else spark.conf.unset(batches.STATE_STORE[0])


def a_try(batch, number, groups):
    """Rows of a try: groups of scores."""
    of = sum(map(len, groups))
    return [(batch, number, of, f"{number}.{g}", 100 * number + 10 * g + k, float(s)) for g, scores in enumerate(groups) for k, s in enumerate(scores)]


class Stream:
    """A folder of rows, one file each time, read by a query that is started anew each time."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options = spark, tmp_path, options

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        query = batches.fill_batches(stream, **self.options).writeStream.format("parquet").option("checkpointLocation", str(self.path / "cp")).option("path", str(self.path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.batch, r.sample, r.tries, r.outcome) for r in self.spark.read.parquet(str(self.path / "out")).collect())


def test_batches_fill_over_tries_and_restarts(store, tmp_path):
    s = Stream(store, tmp_path, size=4, most=3)
    s.put(a_try("a", 1, [(0, 1), (1, 1)]) + a_try("b", 1, [(0, 0), (1, 1)]))
    assert s.run() == []
    second = a_try("a", 2, [(0, 0), (2, 1), (3, 1)])
    s.put(second[:4] + a_try("b", 2, [(5, 5)]))  # a try that comes in pieces does not count yet
    assert s.run() == []
    s.put(second[4:])
    filled = [("a", x, 2, "filled") for x in (100, 101, 210, 211)]
    assert s.run() == filled
    s.put(a_try("b", 3, [(0, 1)]) + a_try("a", 3, [(0, 1)]))  # too few for b, too late for a
    out = s.run()
    assert out == filled + [("b", x, 3, "fallback") for x in (100, 101, 110, 111)]
    s.put(a_try("b", 4, [(0, 1), (0, 1)]))
    assert s.run() == out


def test_tries_that_come_together_count_in_their_order(store, tmp_path):
    s = Stream(store, tmp_path, size=4, most=0)
    s.put(a_try("a", 3, [(7, 8)]) + a_try("a", 2, [(1, 1)]) + a_try("a", 1, [(0, 1)]))
    assert s.run() == [("a", x, 3, "filled") for x in (100, 101, 300, 301)]


def test_strict_batches_fail_when_nothing_is_kept(store, tmp_path):
    s = Stream(store, tmp_path, size=4, most=3, rule=batches.between(0.1, 0.9), strict=True)
    s.put(a_try("a", 1, [(0, 1), (1, 1)]))
    s.run()
    s.put(a_try("a", 2, [(1, 1), (0, 0)]))
    with pytest.raises(Exception, match="no sample of try 2 of batch a is kept"):
        s.run()


def test_strict_batches_fail_after_their_last_try(store, tmp_path):
    s = Stream(store, tmp_path, size=9, most=2, rule=batches.between(0.1, 0.9), strict=True)
    s.put(a_try("a", 1, [(0, 1)]))
    s.put(a_try("a", 2, [(0, 1)]))
    with pytest.raises(Exception, match="has 4 of 9 samples after 2 tries"):
        s.run()


def test_a_batch_that_nothing_comes_for_is_ended(store, tmp_path):
    s = Stream(store, tmp_path, size=9, most=5, patience_ms=500)
    s.put(a_try("a", 1, [(0, 1)]))
    stream = store.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = batches.fill_batches(stream, **s.options).writeStream.format("memory").queryName("ended").start()
    try:
        for _ in range(40):
            rows = store.table("ended").collect()
            if rows or query.awaitTermination(1):
                break
    finally:
        query.stop()
    assert sorted((r.sample, r.outcome) for r in rows) == [(100, "fallback"), (101, "fallback")]
