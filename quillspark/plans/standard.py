"""Queries on datasets of several forms, and on work to be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import checks
from quillspark.operators.evaluation import pending_rows
from quillspark.operators.relations import table
from quillspark.plans.registry import query
from quillspark.sources import standard


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a text in one of four forms, some with a system text of their own."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role"), "text")
    kind = F.col("conv_id") % 4
    other = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").when(F.col("role") == "system", "function-call").otherwise(F.col("role"))
    one = F.when(kind == 0, F.to_json(F.struct(other.alias("from"), F.col("text").alias("value")), {"ignoreNullFields": "false"})).when(kind == 1, F.to_json(F.struct("role", F.col("text").alias("content")), {"ignoreNullFields": "false"}))
    pair = F.to_json(F.struct(F.col("text").alias("human"), F.concat(F.lit("re: "), F.col("role")).alias("bot")), {"ignoreNullFields": "false"})
    # a text in quotes is a literal of Python too, but single quotes and the last comma are no JSON
    literal = F.concat(F.lit("{'role': 'bot', 'value': "), F.substring(F.to_json(F.array(F.coalesce("text", F.lit("")))), F.lit(2), F.length(F.to_json(F.array(F.coalesce("text", F.lit(""))))) - 2), F.lit(",}"))
    rows = t.withColumn("one", F.coalesce(one, F.when(kind == 2, pair).otherwise(literal)))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "one"))).alias("l"))
    return whole.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["one"]), ", "), F.lit("]")).alias("conversations"), F.when(F.col("conv_id") % 3 == 0, "be brief").alias("system_prompt"))


@query(
    "conversation_forms",
    """with t as (select conv_id, turn, coalesce(role, 'none') as role, text, conv_id % 4 as kind from conversations),
m as (select conv_id, turn, 0 as k, case kind when 0 then case role when 'system' then 'tool_call' else role end when 1 then role when 2 then 'user' else 'assistant' end as role, case when kind = 3 then coalesce(text, '') else text end as content from t
  union all select conv_id, turn, 1, 'assistant', 're: ' || role from t where kind = 2
  union all select conv_id, -1, 0, 'system', 'be brief' from t where conv_id % 3 = 0 group by conv_id, kind having kind <> 1 or arg_min(role, turn) <> 'system')
select conv_id, row_number() over (partition by conv_id order by turn, k) - 1 as position, role, content from m""",
)
def conversation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard messages of conversations in four forms."""
    rows = standard.auto_rows(_forms(spark, sf_dir))
    out = rows.select("conv_id", F.posexplode("messages").alias("position", "m"))
    return out.select("conv_id", F.col("position").cast("bigint").alias("position"), "m.role", "m.content")


@query(
    "response_forms",
    """select p_partkey, case when p_partkey % 2 = 0 then ['user', 'assistant', 'user', 'assistant'] else ['user', 'assistant'] end as roles, case when p_partkey % 2 = 0 then [p_brand, 'a "b"', p_name, p_type] else [p_name, p_type] end as contents from part""",
)
def response_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of queries with lists of responses and literals of earlier pairs."""
    history = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[('"), "p_brand", F.lit("', 'a \"b\"')]")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.array("p_type", F.lit("other")).alias("answers"), history.alias("history"))
    return standard.auto_rows(rows).select("p_partkey", F.transform("messages", lambda m: m["role"]).alias("roles"), F.transform("messages", lambda m: m["content"]).alias("contents"))


@query(
    "resume_by_mode",
    """with r as (select c_custkey as id, o_orderkey as seq, case o_orderkey % 4 when 0 then null when 3 then 'soft' else 'full' end as mode, o_orderkey % 5 = 0 as error, o_orderkey % 7 = 0 as bad from orders join customer on o_custkey = c_custkey),
l as (select id, arg_max(coalesce(mode, 'full'), seq) as mode, arg_max(error, seq) as error, arg_max(bad, seq) as bad from r group by 1)
select c_custkey as id, cast(greatest(1, c_nationkey * 100 - c_custkey) as bigint) as tokens from customer left join l on id = c_custkey where id is null or not (mode = 'full' and not error and not bad)""",
)
def resume_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a result that counts, and how many tokens the retry may ask for."""
    o = F.col("o_orderkey")
    results = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), o.alias("seq"), F.when(o % 4 == 3, "soft").when(o % 4 > 0, "full").alias("reward_mode"), F.when(o % 5 == 0, "timeout").alias("error"), F.when(o % 7 == 0, "no list").alias("parse_error"))
    said = F.concat(F.lit("too long: 9000 > "), (F.col("c_nationkey") * 100).cast("string"), F.lit(" - "), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), checks.retry_tokens(said).alias("tokens"))
    return pending_rows(rows, results, "id", "seq", "full", True, True)
