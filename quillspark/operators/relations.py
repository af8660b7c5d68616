"""Relations of step supervision derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_shipdate", "l_discount", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, step_index, score (null beyond a quantity of 49), pred {0, 1, -2}, data_source."""
    w = W.partitionBy("l_orderkey").orderBy(*_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_key"),
        (F.row_number().over(w) - 1).alias("step_index"),
        F.when(F.col("l_quantity") <= 49, F.round(F.col("l_discount") * 10, 1)).alias("score"),
        F.when(F.col("l_tax") <= 0.03, 0).when(F.col("l_tax") <= 0.06, 1).otherwise(-2).alias("pred"),
        F.col("l_returnflag").alias("data_source"),
    )


STEPS = f"""steps as (select l_orderkey as source_key, row_number() over (partition by l_orderkey order by {", ".join(_ORDER)}) - 1 as step_index,
 case when l_quantity <= 49 then round(l_discount * 10, 1) end as score, case when l_tax <= 0.03 then 0 when l_tax <= 0.06 then 1 else -2 end as pred, l_returnflag as data_source from lineitem)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, source_annotation, scores and preds in step order."""
    rows = steps(spark, sf_dir).groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("step_index", "score", "pred"))).alias("s"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_key"), F.col("o_orderpriority").alias("source_annotation"))
    return rows.join(orders, "source_key").select("source_key", "source_annotation", F.col("s.score").alias("scores"), F.col("s.pred").alias("preds"))


SOURCES = f"""{STEPS}, sources as (select source_key, o_orderpriority as source_annotation, list(score order by step_index) as scores, list(pred order by step_index) as preds
 from steps join orders on o_orderkey = source_key group by all)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index (user and day), candidate_idx by time, score (null on errors), answer, error."""
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("index"),
        (F.row_number().over(w) - 1).alias("candidate_idx"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("score"),
        F.get_json_object("props", "$.k").alias("answer"),
        (F.col("event_type") == "error").alias("error"),
    )


CANDIDATES = """candidates as (select cast(user_id as varchar) || ':' || strftime(ts, '%Y-%m-%d') as "index",
 row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as candidate_idx, case when event_type <> 'error' then value end as score,
 json_extract_string(props, '$.k') as answer, event_type = 'error' as error from events)"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, item, reward."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 1e5).alias("reward"))


REWARDS = "rewards as (select o_custkey as uid, o_orderkey as item, o_totalprice / 1e5 as reward from orders)"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, backend, mode, latency_sec, num_steps, prompt_tokens, completion_tokens, error."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("backend"), F.col("event_type").alias("mode"), F.col("value").alias("latency_sec"),
        (F.col("user_id") % 7 + 1).alias("num_steps"), (F.col("event_id") % 97).alias("prompt_tokens"), (F.col("event_id") % 31).alias("completion_tokens"), (F.col("event_type") == "error").alias("error"),
    )


COSTS = """costs as (select event_id as id, 'b' || (user_id % 3) as backend, event_type as mode, value as latency_sec, user_id % 7 + 1 as num_steps,
 event_id % 97 as prompt_tokens, event_id % 31 as completion_tokens, event_type = 'error' as error from events)"""
