"""Queries on layouts, balance, divergence, validity, image paths and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import balance, divergence, layout, validity
from quillspark.operators.relations import STEPS, steps, table
from quillspark.plans.registry import query
from quillspark.sources import discovery
from quillspark.sources.scratch import kept


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, n, place, start, end: the places of each source's steps in one row; the sizes, which are counted once, are read by each pass over them."""
    sizes = kept(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source_key")).agg(F.count("*").alias("n")), "sizes")
    return layout.offsets(layout.placed(sizes, "source_key", []), "n")


@query(
    "flat_offsets",
    """with s as (select source_key, count(*) as n from (select l_orderkey as source_key from lineitem) group by 1)
select source_key, row_number() over (order by source_key) - 1 as place, cast(sum(n) over (order by source_key) - n as bigint) as first, cast(sum(n) over (order by source_key) as bigint) as last from s""",
)
def flat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source's steps lie when all stand in one row."""
    return _offsets(spark, sf_dir).select("source_key", "place", F.col("start").alias("first"), F.col("end").alias("last"))


@query(
    "padded_back",
    f"""with {STEPS}, s as (select source_key, list(coalesce(score, -1) order by step_index) as v from steps group by 1)
select source_key, case when len(v) >= 4 then v[len(v) - 3:] else list_transform(range(4 - len(v)), lambda i: -9.0) || v end as scores, case when len(v) >= 4 then [1, 1, 1, 1] else list_transform(range(4), lambda i: case when i < 4 - len(v) then 0 else 1 end) end as mask from s""",
)
def padded_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that stand in one row of all sources, given back to each source, padded on the left."""
    items = steps(spark, sf_dir).select("source_key", "step_index", F.coalesce("score", F.lit(-1.0)).alias("value"))
    rows = kept(_offsets(spark, sf_dir), "offsets")
    flat = items.join(rows.select("source_key", "start"), "source_key").select((F.col("start") + F.col("step_index")).alias("at"), "value")
    out = layout.padded(flat, rows, 4, F.lit(-9.0))
    return out.select("source_key", F.col("values").alias("scores"), "mask")


@query(
    "class_batches",
    """with o as (select o_orderkey, o_totalprice > 3000 as capped, o_totalprice, row_number() over (partition by o_totalprice > 3000 order by md5('0:' || o_orderkey), o_orderkey) - 1 as r from orders),
n as (select count(*) filter (capped) as c, count(*) filter (not capped) as o from o), a as (select *, least(c // 9, o // 23) as k from n), b as (select *, c - 9 * k as lc, o - 23 * k as lo from a), f as (select *, least(9, lc) as fc, least(32 - least(9, lc), lo) as fo from b),
m as (select *, fc + least(32 - fc - fo, lc - fc) as mc from f), g as (select *, fo + least(32 - mc - fo, lo - fo) as mo from m),
x as (select o_orderkey, capped, case when capped then case when r < 9 * k then r // 9 when r - 9 * k < mc then k else k + 1 + (r - 9 * k - mc) // 32 end else case when r < 23 * k then r // 23 when r - 23 * k < mo then k else k + 1 + (r - 23 * k - mo) // 32 end end as batch from o, g)
select batch, count(*) as n, count(*) filter (capped) as capped, min(o_orderkey) as least from x group by 1""",
)
def class_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 with at most nine of one class while the other lasts."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 3000).alias("capped"))
    out = balance.capped_batches(rows, "capped", "o_orderkey", 32, 0.3)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("capped").alias("capped"), F.min("o_orderkey").alias("least"))


_DIVERGENCE = """with r as (select l_orderkey as position, l_partkey % 7 as token, avg(l_quantity) / 10 as s, avg(l_discount) * 20 as t, min(l_linenumber) as first from lineitem group by 1, 2),
b as (select position, token, case when first = 2 and token > 0 then t else s end as s, case when first = 3 and token > 0 then s else t end as t from r),
p as (select position, exp(s) / sum(exp(s)) over (partition by position) as s, exp(t) / sum(exp(t)) over (partition by position) as t from b)"""


def _logits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sides' logits of some tokens, each side without some of the tokens."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("position"), (F.col("l_partkey") % 7).alias("token")).agg((F.avg("l_quantity") / 10).alias("s"), (F.avg("l_discount") * 20).alias("t"), F.min("l_linenumber").alias("first"))
    student = r.where("not (first = 2 and token > 0)").select("position", "token", F.col("s").alias("logit"))
    return student, r.where("not (first = 3 and token > 0)").select("position", "token", F.col("t").alias("logit"))


@query(
    "token_divergence",
    _DIVERGENCE + """, h as (select distinct l_orderkey as position from lineitem), d as (select position, sum(0.3 * t * ln(t / (0.7 * s + 0.3 * t)) + 0.7 * s * ln(s / (0.7 * s + 0.3 * t))) as divergence, count(*) as tokens from p group by 1),
has as (select position, bool_or(not (first = 2 and token > 0)) as hs, bool_or(not (first = 3 and token > 0)) as ht from r group by 1) select d.position, round(greatest(0.0, divergence), 9) as divergence, tokens from d join has on d.position = has.position and hs and ht""",
)
def token_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generalised Jensen-Shannon divergence of two sides that name different tokens."""
    out = divergence.divergence(*_logits(spark, sf_dir), ["position"], 0.3)
    return out.select("position", F.round("divergence", 9).alias("divergence"), "tokens")


@query(
    "invalid_rows",
    """with m as (select conv_id, list(role order by turn) as roles, list(text order by turn) as texts, max(turn) as last from conversations where role <> 'system' group by 1),
r as (select case when len(list_filter(roles, lambda x: x is null or x not in ('system', 'user', 'tool_call', 'tool_response', 'tool', 'assistant'))) > 0 then 'bad_role' when len(list_filter(texts, lambda x: x is null)) > 0 then 'no_content' when texts[1] is not distinct from texts[-1] then 'rejected_is_chosen' when last > 4 then 'too_long' else 'ok' end as reason from m)
select reason, count(*) as rows from r group by 1""",
)
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by the first check that they fail; the rejected reply is the first turn."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    m = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"), F.max("turn").alias("last"))
    checks = validity.message_checks(F.col("m"), F.try_element_at("m", F.lit(1))["content"]) | validity.length_checks(F.col("last"), 4)
    return validity.reason_counts(m, checks)


@query(
    "image_paths",
    """with f as (select '/img/c' || c_custkey || '.png' as path from customer union select '/img/nlvr2/images/s' || s_suppkey || '.png' from supplier union select '/data/p' || p_partkey || '.png' from part),
e as (select event_id, case event_id % 7 when 0 then 'x/VisualPRM400K-v1.1-Raw/images/a' || user_id || '.png' when 1 then 'images/c' || user_id * 31 || '.png' when 2 then 'images\\s' || user_id || '.png' when 3 then 'p' || user_id * 40 || '.png' when 4 then '/img/c' || user_id * 31 || '.png' when 5 then '' end as raw, user_id as u from events)
select event_id, case event_id % 7 when 0 then '/img/a' || u || '.png' when 1 then '/img/c' || u * 31 || '.png' when 2 then case when n.path is not null then n.path else '/img/s' || u || '.png' end when 3 then coalesce(d.path, '/img/p' || u * 40 || '.png') when 4 then raw end as resolved
from e left join f n on n.path = '/img/nlvr2/images/s' || u || '.png' left join f d on d.path = '/data/p' || u * 40 || '.png'""",
)
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of images put right by a listing of files."""
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".png")).alias("path")
    files = table(spark, sf_dir, "customer").select(name("/img/c", "c_custkey")).unionAll(table(spark, sf_dir, "supplier").select(name("/img/nlvr2/images/s", "s_suppkey"))).unionAll(table(spark, sf_dir, "part").select(name("/data/p", "p_partkey")))
    u, kind = F.col("user_id"), F.col("event_id") % 7
    path = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"), F.lit(".png"))
    raw = F.when(kind == 0, path("x/VisualPRM400K-v1.1-Raw/images/a", u)).when(kind == 1, path("images/c", u * 31)).when(kind == 2, path("images\\s", u)).when(kind == 3, path("p", u * 40)).when(kind == 4, path("/img/c", u * 31)).when(kind == 5, "")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return discovery.resolve_images(rows, "raw", files, "/img", "/data").select("event_id", "resolved")


@query(
    "cost_rows",
    """with s as (select user_id, event_type, count(*) as n, sum(user_id % 7 + 1) as steps, sum(value) as wall, sum(event_id % 97) as prompt, sum(event_id % 31) as generated from events group by 1, 2)
select user_id % 3 || ':' || event_type as method, n as num_samples, cast(steps as bigint) as num_steps, round(wall / n, 9) as avg_time_per_sample_s, round(case when user_id % 4 = 0 then 2.0 * prompt else prompt end / n, 9) as avg_input_tokens_per_sample, case when user_id % 4 = 0 then 'text_tokenizer_estimate' else 'api_prompt_tokens' end as input_token_source,
  round(case when user_id % 5 > 0 then generated / n when user_id % 3 = 0 then 0 else generated * 3 / n end, 9) as avg_output_tokens_per_sample, case when user_id % 5 > 0 then 'api_completion_tokens' when user_id % 3 = 0 then 'not_applicable_visualprm_soft_score' else 'counted' end as output_token_source, cast(user_id as varchar) as summary_path from s where n >= 3 and user_id % 11 > 0 and prompt > 0 and generated > 0""",
)
def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs cost, from summaries in three shapes of JSON and one that is none."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("user_id") % 7 + 1).alias("steps"), F.sum("value").alias("wall"), F.sum(F.col("event_id") % 97).alias("prompt"), F.sum(F.col("event_id") % 31).alias("generated")).where("prompt > 0 and generated > 0")
    u = F.col("user_id")
    usage = F.struct(F.when(u % 4 > 0, F.col("prompt")).alias("prompt_tokens"), F.when(u % 5 > 0, F.col("generated")).alias("completion_tokens"))
    one = F.struct((u % 3).cast("string").alias("backend"), F.col("event_type").alias("mode"), F.col("n").alias("num_samples"), F.col("steps").alias("num_steps"), F.col("wall").alias("wall_time_sec"), usage.alias("usage"), (F.col("prompt") * 2).alias("text_input_tokens"), (F.col("generated") * 3).alias("generated_tokens"), F.lit("counted").alias("generated_tokens_source"))
    shape = F.when(u % 11 == 0, F.to_json(F.struct(one.alias("other")))).when(u % 11 < 4, F.to_json(F.struct(F.array(one).alias("summaries")))).when(u % 11 < 8, F.to_json(F.struct(one.alias("summary")))).otherwise(F.to_json(one))
    texts = e.select(shape.alias("value"), u.cast("string").alias("summary_path")).unionAll(e.select(F.lit("no json"), F.lit("none")))
    out = discovery.cost_rows(discovery.summaries(texts, strict=False), soft="0", least=3)
    return out.select("method", "num_samples", "num_steps", *(F.round(c, 9).alias(c) for c in ("avg_time_per_sample_s", "avg_input_tokens_per_sample", "avg_output_tokens_per_sample")), "input_token_source", "output_token_source", "summary_path")


@query(
    "balanced_loads",
    """with recursive n as (select cast(length(text) as bigint) // 64 as n, row_number() over (order by length(text) // 64 desc) as i from documents where text is not null),
g as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as loads union all select n.i, list_sort(list_append(g.loads[2:], g.loads[1] + n.n)) from g join n on n.i = g.i + 1)
select unnest(range(5)) as nth, unnest(loads) as load from g where i = (select count(*) from n)""",
)
def balanced_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of five parts to which texts were dealt, longest first."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr("length(text) div 64").alias("n"))
    loads = balance.balanced(rows, "n", "doc_id", 5).groupBy("part").agg(F.sum("n").alias("load"))
    return loads.select(F.expr("cast(row_number() over (order by load) - 1 as bigint) as nth"), "load")  # five rows


@query(
    "budgeted_batches",
    """with n as (select doc_id, cast(length(text) as bigint) // 64 as n from documents where text is not null), k as (select least(count(*), ceil(sum(n) / 2000)) as k, sum(n) as total from n)
select cast(k as bigint) as batches, cast(total as bigint) as total, true as within, true as ordered from k""",
)
def budgeted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of texts by a budget of tokens: how many, and whether loads are within a text of each other and the dearest come first."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr("length(text) div 64").alias("n"))
    each = balance.budget_batches(rows, "n", "doc_id", 2000, strict=False).groupBy("batch").agg(F.sum("n").alias("load"), F.max("n").alias("longest"), F.sum(F.col("n") * F.col("n")).alias("cost"))
    following = each.select((F.col("batch") - 1).alias("batch"), F.col("cost").alias("next"))
    within, ordered = F.max("load") - F.min("load") <= F.max("longest"), F.min(F.col("cost") >= F.col("next"))
    out = each.join(following, "batch", "left").agg(F.count("batch").alias("batches"), F.sum("load").alias("total"), F.coalesce(within, F.lit(True)).alias("within"), F.coalesce(ordered, F.lit(True)).alias("ordered"))
    return out
