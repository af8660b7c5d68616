"""Further queries: overlap scores, in-batch contrast, boxes, metric leaves, sessions, negatives, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import texts, vectors
from quillspark.operators.relations import STEPS, sources, table
from quillspark.operators.sampling import numbered
from quillspark.operators.supervision import hash_order
from quillspark.plans.registry import query
from quillspark.sources.preprocessors import scaled

_PAIRS = "p as (select a.conv_id, a.turn, a.text as hyp, b.text as ref from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


#: Texts that meet in one task.
TEXTS = 10_000


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, hyps, refs: the texts of a turn and those of the next, of which each is one unless rows recur; null is empty.

    The parts grow with the texts, so that a task sorts no more of a larger table.
    """
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    both = t.select("conv_id", "turn", F.col("text").alias("hyp"), none.alias("ref")).unionAll(t.select("conv_id", F.col("turn") - 1, none, "text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * t.count() // TEXTS)
    lists = both.repartition(parts, "conv_id", "turn").groupBy("conv_id", "turn").agg(F.collect_list("hyp").alias("hyps"), F.collect_list("ref").alias("refs"))
    return lists.where("size(hyps) > 0 and size(refs) > 0")


@query(
    "rouge_unigrams",
    f"""with {_PAIRS}, h as (select conv_id, turn, unnest(list_filter(string_split(lower(hyp), ' '), lambda x: x <> '')) as w, 1 as h, 0 as r from p union all select conv_id, turn, unnest(list_filter(string_split(lower(ref), ' '), lambda x: x <> '')), 0, 1 from p),
c as (select conv_id, turn, w, sum(h) as h, sum(r) as r from h group by 1, 2, 3), f as (select conv_id, turn, 2.0 * sum(least(h, r)) / sum(h + r) as f from c group by 1, 2 having sum(h) > 0 and sum(r) > 0) select round_even(100 * avg(f), 6) as rouge_1, count(*) as pairs from f""",
)
def rouge_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap F of the words of neighbouring turns; empty texts drop out."""
    words = lambda c: F.filter(F.flatten(F.transform(c, lambda t: F.split(F.lower(t), " "))), lambda w: w != "")
    p = _pairs(spark, sf_dir).select(words("hyps").alias("h"), words("refs").alias("r"), F.size("hyps").cast("bigint").alias("nh"), F.size("refs").cast("bigint").alias("nr"))
    p = p.where("size(h) > 0 and size(r) > 0")
    shared = texts.shared_words(F.col("h"), F.col("r"), F.col("nr"), F.col("nh"))  # each text stands in as many pairs as the other side has
    f = p.select((2.0 * shared / (F.size("h") * F.col("nr") + F.size("r") * F.col("nh"))).alias("f"))
    return f.agg(F.bround(100 * F.avg("f"), 6).alias("rouge_1"), F.count("*").alias("pairs"))


@query(
    "info_nce",
    """with e as (select vec_id, vec_id // 16 as batch, list_transform(embedding, lambda x: cast(x as double)) as v, label from embeddings), s as (select a.vec_id, a.batch, list_cosine_similarity(a.v, b.v) as s, a.label = b.label as same from e a join e b on a.batch = b.batch and a.vec_id <> b.vec_id)
select batch, round(avg(s) filter (same), 6) as mean_pos, round(avg(s) filter (not same), 6) as mean_neg, round(avg(s) filter (same) - avg(s) filter (not same), 6) as margin from s group by 1""",
)
def info_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to positives and in-batch negatives in batches of sixteen, the bound of the join."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 16").alias("batch"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    b = e.select("batch", F.col("vec_id").alias("other"), F.col("v").alias("w"), F.col("label").alias("l"))
    s = e.join(b, "batch").where("vec_id <> other").select("batch", vectors.cosine(F.col("v"), F.col("w")).alias("s"), (F.col("label") == F.col("l")).alias("same"))
    pos, neg = F.avg(F.when(F.col("same"), F.col("s"))), F.avg(F.when(~F.col("same"), F.col("s")))
    return s.groupBy("batch").agg(F.round(pos, 6).alias("mean_pos"), F.round(neg, 6).alias("mean_neg"), F.round(pos - neg, 6).alias("margin"))


@query("box_rescale", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(least(l_quantity, l_tax * 500) / 50 * 1000, 0) as int) as x1, cast(round_even(greatest(l_quantity, l_tax * 500) / 50 * 1000, 0) as int) as x2, cast(round_even(l_discount * 100 / 30 * 1000, 0) as int) as y from lineitem")
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with corners in order, in thousandths of the picture."""
    x1, x2 = F.least("l_quantity", F.col("l_tax") * 500), F.greatest("l_quantity", F.col("l_tax") * 500)
    box = scaled(F.array(x1, F.col("l_discount") * 100, x2, F.col("l_discount") * 100), F.lit(50), F.lit(30))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(box, 0).alias("x1"), F.get(box, 2).alias("x2"), F.get(box, 1).alias("y"))


@query("metric_leaves", "select c_custkey as step, unnest(['account/balance', 'account/nation', 'length/name']) as metric, unnest([c_acctbal, cast(c_nationkey as double), cast(length(c_name) as double)]) as value from customer")
def metric_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested numbers as rows of path and value."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"), F.col("c_acctbal").alias("account/balance"), F.col("c_nationkey").cast("double").alias("account/nation"), F.length("c_name").cast("double").alias("length/name"))
    return c.unpivot("step", ["account/balance", "account/nation", "length/name"], "metric", "value")


@query("percent_values", "select event_id, case when event_id % 2 = 0 then value / 100 when value > 1 then value / 100 else value end as share from (select event_id, cast(round(value, 2) as double) as value from events where value >= 0)")
def percent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares from texts with and without a percent sign."""
    v = F.round("value", 2)
    text = F.when(F.col("event_id") % 2 == 0, F.concat(v.cast("decimal(18,2)").cast("string"), F.lit("%"))).otherwise(v.cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "events").where("value >= 0").select("event_id", texts.percent(text).alias("share"))


@query("channel_means", "select coalesce(source, 'none') as channel, avg(length(text)) as mean_length, count(*) as rows, stddev_pop(length(text)) as std from documents group by 1")
def channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean for each channel."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("channel")).agg(F.avg(F.length("text")).alias("mean_length"), F.count("*").alias("rows"), F.stddev_pop(F.length("text")).alias("std"))


@query("early_stopping", """with s as (select event_type as metric, cast(ts as date) as step, sum(value) as value from events group by 1, 2), b as (select *, max(value) over (partition by metric order by step rows between unbounded preceding and 1 preceding) as best from s),
i as (select *, sum(case when best is null or value > best then 1 else 0 end) over (partition by metric order by step) as island from b) select metric, step, value, row_number() over (partition by metric, island order by step) - 1 as waited from i""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps since the last improvement of each series."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("step")).agg(F.sum("value").alias("value"))
    b = s.withColumn("best", F.expr("max(value) over (partition by metric order by step rows between unbounded preceding and 1 preceding)"))
    i = b.withColumn("island", F.expr("sum(case when best is null or value > best then 1 else 0 end) over (partition by metric order by step)"))
    return i.selectExpr("metric", "step", "value", "cast(row_number() over (partition by metric, island order by step) - 1 as bigint) as waited")


@query("session_islands", """with s as (select user_id, event_id, ts, event_type, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from events)
select user_id, session, count(*) as actions, min(ts) as first_ts, string_agg(event_type, ',' order by ts, event_id) as path from s where session > 0 group by 1, 2""")
def session_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions grouped into sessions that a signup starts; earlier ones are dropped."""
    s = table(spark, sf_dir, "events").withColumn("session", F.expr("sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id)")).where("session > 0")
    g = s.groupBy("user_id", "session").agg(F.count("*").alias("actions"), F.min("ts").alias("first_ts"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return g.select("user_id", "session", "actions", "first_ts", F.array_join(F.col("x.event_type"), ",").alias("path"))


@query("random_negatives", """with r as (select vec_id, label, row_number() over (order by md5('13:' || vec_id), vec_id) - 1 as p, count(*) over () as n from embeddings) select a.vec_id, b.vec_id as negative, (b.p - a.p + a.n) % a.n as place from r a join r b on (b.p - a.p + a.n) % a.n between 1 and 3 and a.label <> b.label""")
def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three rows of other labels for each row: its successors in a hash order."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = numbered(e, [hash_order("13", "vec_id"), F.col("vec_id")], "p")
    n = e.count()
    a = r.select("vec_id", "label", "p", F.explode(F.array(*map(F.lit, (1, 2, 3))).cast("array<bigint>")).alias("place"))
    b = r.select(F.col("vec_id").alias("negative"), F.col("label").alias("l"), F.col("p").alias("q"))
    return a.join(b, (F.col("p") + F.col("place")) % n == F.col("q")).where("label <> l").select("vec_id", "negative", "place")


@query("sublist_positions", f"with {STEPS}, s as (select source_key, step_index, pred, lead(pred) over (partition by source_key order by step_index) as nxt from steps) select source_key, step_index as position from s where pred = 0 and nxt = 1")
def sublist_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pair 0, 1 occurs in each list of predictions."""
    p = sources(spark, sf_dir).select("source_key", "preds")
    at = F.filter(F.transform("preds", lambda x, i: F.when((x == 0) & (F.get("preds", i + 1) == 1), i)), lambda i: i.isNotNull())
    return p.select("source_key", F.explode(at.cast("array<bigint>")).alias("position"))


@query("padded_lists", f"with {STEPS} select source_key, array_to_string(list(pred order by step_index)[:4] || list_transform(range(greatest(0, 4 - count(*))), lambda i: 9), ',') as kept_left, array_to_string(list(pred order by step_index)[-4:], ',') as kept_right, least(count(*), 4) as n from steps group by 1")
def padded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists cut to four from either side; the one cut on the right is padded."""
    p = sources(spark, sf_dir).select("source_key", "preds", F.least(F.size("preds"), F.lit(4)).alias("n"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    left = F.concat(F.slice("preds", 1, 4), F.array_repeat(F.lit(9), F.lit(4) - F.col("n")))
    return p.select("source_key", text(left).alias("kept_left"), text(F.slice("preds", -F.col("n"), F.col("n"))).alias("kept_right"), F.col("n").cast("bigint").alias("n"))
