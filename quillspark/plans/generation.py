"""Queries about generated texts: overlap with references, parts at delimiters, calls of tools, rewards by name and metrics with a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import rule_rewards, toolcalls
from quillspark.functions.plugins import REWARDS, weighted, with_reward
from quillspark.operators import generation, metrics
from quillspark.operators.relations import table
from quillspark.plans.registry import query

_OVERLAP = r"""with recursive t as (select conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') as w from conversations),
p as (select row_number() over (order by a.conv_id, a.turn) as id, a.conv_id, a.turn, a.role, a.w as h, b.w as r from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
live as (select * from p where len(h) > 0 and len(r) > 0),
l as (
  select id, 0 as i, cast(j as bigint) as j, 0::bigint as v from live, unnest(range(1, len(r) + 1)) u(j)
  union all
  select id, i, j, max(c) over (partition by id order by j) as v from (
    select l.id, l.i + 1 as i, l.j, case when live.h[l.i + 1] = live.r[l.j] then coalesce(lag(l.v) over (partition by l.id order by l.j), 0) + 1 else l.v end as c from l join live on live.id = l.id where l.i < len(live.h))),
lcs as (select live.id, l.v as lcs from l join live on live.id = l.id and l.i = len(h) and l.j = len(r)),
g as (
  select id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) as g, 1 as h, 0 as r from live, unnest([1, 2, 3, 4]) o(n)
  union all select id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))), 0, 1 from live, unnest([1, 2, 3, 4]) o(n)),
m as (select id, n, sum(least(h, r)) as hits from (select id, n, g, sum(h) as h, sum(r) as r from g group by all) group by all),
k as (select live.id, o.n, coalesce(hits, 0) as hits, greatest(len(h) - o.n + 1, 0) as a, greatest(len(r) - o.n + 1, 0) as b, sum(case when coalesce(hits, 0) = 0 then 1 else 0 end) over (partition by live.id order by o.n) as missed
  from live cross join unnest([1, 2, 3, 4]) o(n) left join m on m.id = live.id and m.n = o.n),
s as (select id, coalesce(max(2.0 * hits / nullif(a + b, 0)) filter (n = 1), 0) as rouge_1, coalesce(max(2.0 * hits / nullif(a + b, 0)) filter (n = 2), 0) as rouge_2, max(hits) filter (n = 1) as first,
  max(case when a > b then 1.0 else exp(1 - b / a::double) end) filter (n = 1) as brevity, exp(sum(ln(case when hits > 0 then hits::double else pow(0.5, missed) end / greatest(a, 1))) / 4) as mean from k group by id),
scored as (select p.conv_id, p.turn, p.role, s.rouge_1, s.rouge_2, 2.0 * lcs / (len(h) + len(r)) as rouge_l, case when first = 0 then 0.0 else brevity * mean end as bleu_4 from p left join s on s.id = p.id left join lcs on lcs.id = p.id)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a text said and the next one as the text wanted."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


@query("text_overlap", _OVERLAP + " select conv_id, turn, round(rouge_1, 9) as rouge_1, round(rouge_2, 9) as rouge_2, round(rouge_l, 9) as rouge_l, round(bleu_4, 9) as bleu_4 from scored")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1, -2, -L and BLEU-4 of neighbouring turns."""
    out = generation.text_scores(_neighbours(spark, sf_dir), "text", "next")
    return out.select("conv_id", "turn", *(F.round(c, 9).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")))


@query("text_overlap_means", _OVERLAP + " select role, round_even(100 * avg(rouge_1), 6) as rouge_1, round_even(100 * avg(rouge_2), 6) as rouge_2, round_even(100 * avg(rouge_l), 6) as rouge_l, round_even(100 * avg(bleu_4), 6) as bleu_4, count(*) as pairs from scored where rouge_1 is not null group by role")
def text_overlap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their means by role."""
    return generation.mean_text_scores(_neighbours(spark, sf_dir), "text", "next", "role")


@query(
    "text_parts",
    r"""with t as (select doc_id, list_prepend('', regexp_extract_all(text, '\. |, |\n')) as k, regexp_split_to_array(text, '\. |, |\n') as c from documents where text is not null),
e as (select doc_id, unnest(k) as key, unnest(c) as content, generate_subscripts(k, 1) as i from t)
select doc_id, key, count(*) as parts, sum(strlen(content)) as bytes, min(md5(content)) as least, max(md5(content)) as most from e where key <> '' or content <> '' group by 1, 2""",
)
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at sentence ends, commas and line ends, which are kept: what follows each."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(toolcalls.split_parts(F.col("text"), [". ", ", ", "\n"])).alias("p"))
    content = F.col("p.content")
    return rows.groupBy("doc_id", F.col("p.key").alias("key")).agg(F.count("*").alias("parts"), F.sum(F.octet_length(content)).alias("bytes"), F.min(F.md5(content)).alias("least"), F.max(F.md5(content)).alias("most"))


@query(
    "tool_calls",
    r"""with d as (select doc_id, replace(replace(replace(replace(text, chr(10), ' Action: '), ' the ', ' Action: '), ', ', ' Action Input: '), '. ', ' Observation: ') as t from documents where text is not null),
p as (select doc_id, unnest(list_prepend('', regexp_extract_all(t, 'Action:|Action Input:|Observation:'))) as key, unnest(regexp_split_to_array(t, 'Action:|Action Input:|Observation:')) as content, generate_subscripts(list_prepend('', regexp_extract_all(t, 'Action:|Action Input:|Observation:')), 1) as i from d),
a as (select *, sum(case when key = 'Action Input:' then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as turn from p where key in ('Action:', 'Action Input:')),
c as (select doc_id, coalesce(turn, 0) as turn, arg_min(content, i) filter (key = 'Action:') as name, max(content) filter (key = 'Action Input:') as arguments from a group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by turn) - 1 as position, regexp_replace(name, '^\s+|\s+$', '', 'g') as name, regexp_replace(arguments, '^\s+|\s+$', '', 'g') as arguments from c where name is not null and arguments is not null""",
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of tools in texts where common words and marks stand for the keywords."""
    text = F.col("text")
    for old, new in (("\n", " Action: "), (" the ", " Action: "), (", ", " Action Input: "), (". ", " Observation: ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    calls = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(toolcalls.react_calls(text)).alias("position", "call"))
    return calls.select("doc_id", F.col("position").cast("bigint").alias("position"), "call.name", "call.arguments")


@query("metric_moments", "select event_type, user_id % 7 as part, count(value) as n, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as deviation, min(value) as least, max(value) as most from events group by 1, 2")
def metric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of values by a metric with a state."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("part"), "value")
    return metrics.grouped_metric(rows, metrics.Moments("value"), "event_type", "part").withColumns({c: F.round(c, 9) for c in ("mean", "deviation")})


@query("metric_mean", "select round(sum(c_acctbal + 2 * c_nationkey) / (2 * count(*)), 9) as value from customer")
def metric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of lists, item by item, over all rows."""
    rows = table(spark, sf_dir, "customer").select(F.array(F.col("c_acctbal"), (F.col("c_nationkey") * 2).cast("double")).alias("x"))
    return metrics.grouped_metric(rows, metrics.Mean("x")).select(F.round("value", 9).alias("value"))


@query(
    "rewards_by_name",
    r"""with e as (select event_id, 'value ' || props || ' of ' || user_id as said, cast(user_id % 3 as varchar) as truth, event_type, json_extract_string(props, '$.k') as k, lead(event_type) over (order by event_id) as type2, lead(json_extract_string(props, '$.k')) over (order by event_id) as k2 from events),
r as (select event_id, cast(regexp_extract(said, '[012]') = truth as double) as choice, cast(coalesce(event_type = type2, false) and k is not distinct from k2 as double) as tool_use from e)
select event_id, choice, tool_use, round(0.25 * choice + 0.75 * tool_use, 9) as reward from r""",
)
def rewards_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward of batches and one of rows, and their weighted sum."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.get_json_object("props", "$.k").alias("k"))
    following = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("type2"), F.col("k").alias("k2"))
    call = lambda kind, k: F.concat(F.lit("Action: "), kind, F.lit("\nAction Input: "), F.to_json(F.struct(k.alias("k")), {"ignoreNullFields": "false"}))
    rows = e.join(following, "event_id", "left")
    said = F.concat(F.lit("value "), "props", F.lit(" of "), F.col("user_id").cast("string"))
    rows = with_reward(rows, REWARDS.get("choice"), said, (F.col("user_id") % 3).cast("string"))
    rows = with_reward(rows, REWARDS.get("tool_use"), F.concat(call(F.col("event_type"), F.col("k")), F.lit("<|im_end|>")), call(F.col("type2"), F.col("k2")))
    out = weighted(rows, {"choice": 0.25, "tool_use": 0.75})
    return out.select("event_id", F.col("choice.overall").alias("choice"), F.col("tool_use.overall").alias("tool_use"), F.round("reward", 9).alias("reward"))


@query(
    "dapo_scores",
    """with s as (select p_partkey, case when length(p_name) % 4 = 0 then 'Answer: 0' || chr(10) else '' end || 'answer : ' || p_size || case when p_partkey % 3 = 0 then ' cm' else '' end as said, p_size % 25 as truth, length(p_name) * 12 as n from part),
a as (select p_partkey, case when try_cast(replace(regexp_extract(said, 'answer : ([^\n]+)', 1), ' cm', '') as int) = truth then 1.0 else -1.0 end::double as accuracy, case when n <= 100 then 0.0 when n <= 150 then (100 - n) / 50 else -1.0 end::double as overlong from s)
select p_partkey, round(accuracy + 0.5 * overlong, 9) as overall, accuracy, round(overlong, 9) as overlong, 0.5 * (accuracy + 1.0) as accuracy_normalized from a""",
)
def dapo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with a penalty for length."""
    said = F.concat(F.when(F.length("p_name") % 4 == 0, "Answer: 0\n").otherwise(""), F.lit("answer : "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " cm").otherwise(""))
    score = rule_rewards.dapo(said, F.length("p_name") * 12, (F.col("p_size") % 25).cast("string"), 150, 50, 0.5)
    rows = table(spark, sf_dir, "part").select("p_partkey", score.alias("s")).select("p_partkey", "s.*")
    return rows.withColumns({c: F.round(c, 9) for c in ("overall", "overlong")})
