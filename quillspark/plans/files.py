"""Queries that write tables and logs in the shared folder and read them again, and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.relations import table
from quillspark.plans.registry import query
from quillspark.sources import discovery, readers
from quillspark.sources.scratch import scratch
from quillspark.streaming import jobs


@query("json_lines_back", "select conv_id, turn, role, text, cast(turn % 3 as double) / 3 as score from conversations")
def json_lines_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines in two files of a folder, one added later, read by their schema."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", ((F.col("turn") % 3).cast("double") / 3).alias("score"))
    path = scratch(spark, "lines")
    readers.append(rows.where("turn % 2 = 0"), path)
    readers.append(rows.where("turn % 2 = 1"), path)
    return readers.read_jsonl(spark, path, rows.schema, strict=True)


@query(
    "table_files_back",
    r"""with r as (select cast(p_partkey as varchar) as id, p_name || ' "x",' || chr(10) || p_brand || chr(9) as text, cast(p_size as varchar) as size from part) select id, text, size, 'csv' as kind from r union all select id, replace(text, chr(9), ' '), size, 'tsv' from r union all select id, text, size, 'orc' from r""",
)
def table_files_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with separators, quotes and line ends in three formats, each read by the ending of its name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(' "x",\n'), "p_brand", F.lit("\t")).alias("text"), F.col("p_size").cast("string").alias("size"))
    base = scratch(spark, "tables")
    readers.write_csv(rows, f"{base}/a.csv", ["id", "text", "size"])
    rows.withColumn("text", F.translate("text", "\t", " ")).write.option("header", True).option("sep", "\t").option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(f"{base}/b.tsv")
    rows.write.orc(f"{base}/c.orc")
    kinds = [readers.read_table(spark, f"{base}/{f}").withColumn("kind", F.lit(f[2:])) for f in ("a.csv", "b.tsv", "c.orc")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("annotation_folder", "select 'lines.jsonl' as source, 'a' || s_suppkey as id, [s_nationkey, s_suppkey] as scores from supplier union all select 'list.json', 'b' || s_suppkey, [s_nationkey] from supplier")
def annotation_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines and JSON arrays in a folder, each row with the file that it is from."""
    s = table(spark, sf_dir, "supplier")
    base = scratch(spark, "annotations")
    lines = s.select(F.to_json(F.struct(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.array(F.col("s_nationkey").cast("bigint"), F.col("s_suppkey").cast("bigint")).alias("scores"))).alias("value"))
    lines.write.text(f"{base}/lines.jsonl")
    item = F.struct(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("id"), F.array(F.col("s_nationkey").cast("bigint")).alias("scores"))
    arrays = s.groupBy(F.expr("s_suppkey div 50").alias("k")).agg(F.collect_list(item).alias("l"))  # fifty of a file
    arrays.select(F.to_json("l").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{base}/list.json")
    out = readers.read_annotations(spark, base, "id string, scores array<bigint>")
    return out.select(F.regexp_extract("source_annotation", r"/([^/]+)/[^/]+$", 1).alias("source"), "id", "scores")


@query("splits_of_a_path", "select o_orderkey, o_custkey from orders where o_custkey % 2 = 1")
def splits_of_a_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of a folder that its spec names."""
    path = scratch(spark, "splits")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 2 == 1, "test").otherwise("train").alias("split")).write.parquet(path)
    return discovery.read_path(spark, f"{path}@test").select("o_orderkey", "o_custkey")


@query("stream_windows", "select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in five-minute windows by a stream over the events."""
    events = table(spark, sf_dir, "events")
    path = scratch(spark, "windows")
    events.write.parquet(f"{path}/in")  # the table may be one file, and a stream reads folders
    counted = jobs.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{path}/in"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_log", "select user_id, event_id, event_type = 'error' as error, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of each user in a log that a stream appends to."""
    path = scratch(spark, "log")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("error"), "value")
    rows.write.parquet(f"{path}/in")
    jobs.append_log(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/log", f"{path}/state").awaitTermination()
    return jobs.current(spark, f"{path}/log", "user_id", "event_id")
