"""Queries about step supervision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.labels import numbered_steps, previous_judgments, step_label
from quillspark.operators import supervision as op
from quillspark.operators.relations import SOURCES, STEPS, sources, steps, table
from quillspark.plans.registry import query

_F1 = "coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0)"
_POS = _F1.format(tp="count(*) filter (truth = 1 and p = 1)", fp="count(*) filter (truth <> 1 and p = 1)", fn="count(*) filter (truth = 1 and p <> 1)")
_NEG = _F1.format(tp="count(*) filter (truth = -1 and p = -1)", fp="count(*) filter (truth <> -1 and p = -1)", fn="count(*) filter (truth = -1 and p <> -1)")


@query(
    "step_macro_f1",
    f"""with {STEPS}, b as (select data_source, case when score <= 0.125 then -1 when score >= 0.75 then 1 else 0 end as truth, case pred when 0 then -1 when 1 then 1 else -2 end as p from steps)
select data_source, count(*) as steps, count(*) filter (p = -2) as invalid_predictions, {_POS} as f1_positive, {_NEG} as f1_negative, ({_POS} + {_NEG}) / 2 as macro_f1
from b where truth <> 0 group by grouping sets ((data_source), ())""",
)
def step_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step macro-F1 per source and over all."""
    truth = F.when(F.col("score") <= 0.125, -1).when(F.col("score") >= 0.75, 1).otherwise(0)
    pred = F.when(F.col("pred") == 0, -1).when(F.col("pred") == 1, 1).otherwise(-2)
    return op.step_f1(steps(spark, sf_dir).select("data_source", truth.alias("truth"), pred.alias("pred")))


@query(
    "source_mean_f1",
    f"""with {STEPS}, b as (select data_source, case when score <= 0.125 then -1 when score >= 0.75 then 1 else 0 end as truth, case pred when 0 then -1 when 1 then 1 else -2 end as p from steps),
f as (select data_source, ({_POS} + {_NEG}) / 2 as m from b where truth <> 0 group by 1) select avg(m) as source_mean, round_even(100 * avg(m), 2) as percent, count(*) as sources from f""",
)
def source_mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unweighted mean of the sources' macro-F1, as the paper table shows it."""
    rows = step_macro_f1(spark, sf_dir).where("data_source is not null")
    return rows.agg(F.avg("macro_f1").alias("source_mean"), F.bround(100 * F.avg("macro_f1"), 2).alias("percent"), F.count("*").alias("sources"))


@query(
    "benchmark_stats",
    f"""with {STEPS} select data_source, count(*) as steps, count(distinct source_key) as samples, count(*) filter (score >= 0.75) as correct, count(*) filter (score <= 0.125) as incorrect,
count(*) filter (score is null or (score > 0.125 and score < 0.75)) as neutral from steps group by 1""",
)
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of samples, steps and labels by source."""
    label = step_label(F.col("score"))
    return steps(spark, sf_dir).groupBy("data_source").agg(F.count("*").alias("steps"), F.countDistinct("source_key").alias("samples"), F.count_if(label == 1).alias("correct"), F.count_if(label == 0).alias("incorrect"), F.count_if(label.isNull()).alias("neutral"))


@query(
    "label_counts_dry_run",
    f"""with {SOURCES}, k as (select *, list_filter(scores, lambda x: x is not null) as known from sources)
select source_annotation, count(*) filter (len(list_filter(known, lambda x: x <= 0.125)) > 0) as negative_any, count(*) filter (len(known) > 0 and known[-1] <= 0.125) as negative_final,
count(*) filter (len(known) > 0 and len(list_filter(known, lambda x: x > 0.125)) = 0) as negative_all, count(*) filter (len(known) > 0 and len(list_filter(known, lambda x: x < 0.75)) = 0) as positive,
count(*) filter (len(list_filter(known, lambda x: x <= 0.125 or x >= 0.75)) > 0) as confident,
cast(sum(len(list_filter(known, lambda x: x <= 0.125))) as bigint) as negative_steps, cast(sum(len(list_filter(known, lambda x: x >= 0.75))) as bigint) as positive_steps,
cast(sum(len(scores) - len(list_filter(known, lambda x: x <= 0.125 or x >= 0.75))) as bigint) as uncertain_steps from k group by 1""",
)
def label_counts_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run of the teacher stage would select."""
    return op.polarity_counts(sources(spark, sf_dir))


@query(
    "reject_reasons",
    f"""with {SOURCES} select case when len(list_filter(scores, lambda x: x is null)) > 0 then 'bad_score' when len(list_filter(scores, lambda x: x > 0.125 and x < 0.875)) > 0 then 'fuzzy_step' else 'ok' end as reason,
count(*) as sources from sources group by 1""",
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the first reason for which they are dropped."""
    return sources(spark, sf_dir).groupBy(op.reject_reason(F.col("scores")).alias("reason")).agg(F.count("*").alias("sources"))


@query(
    "source_summary",
    f"""with {SOURCES}, r as (select source_annotation, len(scores) as n, len(list_filter(scores, lambda x: x <= 0.125)) as neg, len(list_filter(scores, lambda x: x >= 0.75)) as pos from sources)
select source_annotation, count(*) as samples, cast(min(n) as int) as min_steps, cast(max(n) as int) as max_steps, cast(sum(n) as bigint) as steps, cast(sum(neg) as bigint) as negative_steps, cast(sum(pos) as bigint) as positive_steps,
count(*) filter (neg > 0) as with_negative, count(*) filter (neg = 0 and pos > 0) as all_positive, coalesce(sum(neg) / nullif(cast(sum(neg) + sum(pos) as double), 0), 0.0) as negative_ratio from r group by 1""",
)
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and labels of sources by annotation."""
    return op.source_summary(sources(spark, sf_dir))


@query(
    "multiturn_counts",
    f"""with {STEPS}, h as (select *, case when score <= 0.125 then 0 when score >= 0.75 then 1 end as label, pred as teacher, case when pred <> -2 then pred end as judged from steps),
e as (select source_key, label is not null and judged is not null as trained, label is not null and judged is null as missing, judged from h)
select source_key, count(*) as num_steps, count(*) filter (trained) as num_trainable_steps, count(*) filter (not trained) as num_ignored_steps, count(*) filter (trained and judged = 0) as negative_trainable_steps,
count(*) filter (trained and judged = 1) as positive_trainable_steps, count(*) filter (missing) as missing_confident_steps from e group by 1""",
)
def multiturn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the conversations that heads and judged step rows build."""
    heads = sources(spark, sf_dir).select("source_key", "scores", F.col("preds").alias("teacher"))
    rows = steps(spark, sf_dir).where("pred <> -2").select("source_key", "step_index", F.col("pred").alias("judged"))
    return op.multiturn(heads, rows)


@query(
    "complete_groups",
    f"""with {STEPS}, g as (select source_key, count(*) filter (step_index = 0) as heads, count(*) filter (step_index > 0) as rows from steps group by 1)
select case when heads = 0 then 'missing_global' when rows = 0 then 'missing_step_rows' else 'complete' end as outcome, count(*) as groups from g group by 1""",
)
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a global row and step rows, and why others are dropped."""
    g = steps(spark, sf_dir).groupBy("source_key").agg(F.count_if(F.col("step_index") == 0).alias("heads"), F.count_if(F.col("step_index") > 0).alias("rows"))
    return g.groupBy(F.when(F.col("heads") == 0, "missing_global").when(F.col("rows") == 0, "missing_step_rows").otherwise("complete").alias("outcome")).agg(F.count("*").alias("groups"))


@query(
    "previous_judgments",
    f"""with {STEPS}, s as (select source_key, step_index, case when score <= 0.125 then 0 when score >= 0.75 then 1 else -1 end as label from steps)
select a.source_key, a.step_index, coalesce(string_agg('Step ' || b.step_index || ': \\boxed{{' || b.label || '}}', chr(10) order by b.step_index), 'None') as previous
from s a left join s b on a.source_key = b.source_key and b.step_index < a.step_index group by 1, 2""",
)
def previous_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step, the text of the judgments before it."""
    labels = sources(spark, sf_dir).select("source_key", F.transform("scores", lambda x: step_label(x, uncertain=-1)).alias("labels"))
    each = labels.select("source_key", "labels", F.posexplode("labels").alias("step_index", "label"))
    return each.select("source_key", "step_index", previous_judgments(F.expr("slice(labels, 1, step_index)")).alias("previous"))


@query(
    "first_error",
    f"""with {SOURCES} select source_key, coalesce(list_position(list_transform(scores, lambda x: case when x <= 0.125 then 0 when x >= 0.75 then 1 else -1 end), 0), 0) - 1 as first_error,
len(scores) as steps from sources""",
)
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step with label 0, or -1."""
    labels = F.transform("scores", lambda x: step_label(x, uncertain=-1))
    return sources(spark, sf_dir).select("source_key", (F.array_position(labels, 0) - 1).cast("int").alias("first_error"), F.size("scores").cast("bigint").alias("steps"))


@query(
    "rl_rows",
    f"""with {SOURCES}, r as (select *, len(list_filter(scores, lambda x: x <= 0.125)) as neg, len(list_filter(scores, lambda x: x >= 0.875)) as pos from sources where len(list_filter(scores, lambda x: x is null or (x > 0.125 and x < 0.875))) = 0)
select source_key, '{{"step_labels":[' || array_to_string(list_transform(scores, lambda x: case when x <= 0.125 then 0 else 1 end), ',') || '],"negative_steps":' || neg || ',"positive_steps":' || pos || ',"category":"' ||
case when neg = 0 then 'all_positive' when pos = 0 then 'all_negative' else 'mixed' end || '"}}' as ground_truth from r""",
)
def rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of accepted sources, with their ground truth as compact JSON."""
    rows = sources(spark, sf_dir).where(op.reject_reason(F.col("scores")) == "ok").withColumn("step_labels", F.transform("scores", lambda x: step_label(x, high=0.875, uncertain=-1)))
    neg, pos = F.size(F.filter("step_labels", lambda x: x == 0)), F.size(F.filter("step_labels", lambda x: x == 1))
    category = F.when(neg == 0, "all_positive").when(pos == 0, "all_negative").otherwise("mixed")
    return rows.select("source_key", F.to_json(F.struct("step_labels", neg.alias("negative_steps"), pos.alias("positive_steps"), category.alias("category"))).alias("ground_truth"))


@query(
    "solution_text",
    f"""with {SOURCES} select source_key, array_to_string(list_transform(scores, lambda x, i: 'Step ' || (i - 1) || ': score ' || coalesce(cast(x as varchar), 'unknown')), '<step split>') as solution from sources""",
)
def solution_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered steps of a source, joined by the split mark."""
    texts = F.transform("scores", lambda x: F.concat(F.lit("score "), F.coalesce(x.cast("string"), F.lit("unknown"))))
    return sources(spark, sf_dir).select("source_key", F.array_join(numbered_steps(texts), "<step split>").alias("solution"))


@query(
    "stratified_sample",
    """with g as (select *, row_number() over (partition by o_orderpriority order by md5('7:' || o_orderkey), o_orderkey) as rn, greatest(1, cast(round_even(count(*) over (partition by o_orderpriority) * 0.13, 0) as bigint)) as take from orders)
select o_orderkey, o_orderpriority from g where rn <= take""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fraction of each stratum."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return op.stratified(rows, "o_orderpriority", 0.13, [op.hash_order("7", "o_orderkey"), F.col("o_orderkey")])


@query(
    "negative_ratio_pick",
    f"""with {STEPS}, c as (select source_key, count(*) filter (score <= 0.125) as neg, count(*) filter (score >= 0.75) as pos from steps group by 1),
t as (select greatest(0, round_even(sum(neg) * (1 - 0.35) / 0.35, 0) - sum(pos)) as needed from c where neg > 0),
r as (select source_key, pos, sum(pos) over (order by md5('11:' || source_key), source_key rows unbounded preceding) - pos as before from c where neg = 0 and pos > 0)
select source_key, pos as positive_steps from r, t where before < needed""",
)
def negative_ratio_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-positive sources until the negative share of steps is down to 35 %."""
    label = step_label(F.col("score"))
    c = steps(spark, sf_dir).groupBy("source_key").agg(F.count_if(label == 0).alias("neg"), F.count_if(label == 1).alias("positive_steps"))
    neg, pos = c.where("neg > 0").agg(F.sum("neg"), F.sum("positive_steps")).first()
    needed = max(0, round((neg or 0) * (1 - 0.35) / 0.35) - (pos or 0))
    return op.pick_until(c.where("neg = 0"), "positive_steps", needed, [op.hash_order("11", "source_key"), F.col("source_key")]).select("source_key", "positive_steps")


@query(
    "positive_downsample",
    f"""with {STEPS}, l as (select source_key, step_index, case when score <= 0.125 then 0 when score >= 0.75 then 1 end as label from steps),
n as (select cast(trunc(count(*) filter (label = 0) * (1 - 0.5) / 0.5) as bigint) as most from l), r as (select *, row_number() over (partition by label order by md5('3:' || source_key || ':' || step_index), source_key, step_index) as rn from l where label is not null)
select source_key, step_index, label from r, n where label = 0 or rn <= most""",
)
def positive_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive steps down to the number that the target ratio allows."""
    rows = steps(spark, sf_dir).select("source_key", "step_index", step_label(F.col("score")).alias("label")).where("label is not null")
    sizes = rows.groupBy("label").count()
    neg = F.expr("max(case when label = 0 then count end) over ()")  # two rows
    takes = sizes.select("label", F.when(F.col("label") == 0, F.col("count")).otherwise((neg * (1 - 0.5) / 0.5).cast("bigint")).alias("_take"))
    return op.top_by_hash(rows, "label", takes, [op.hash_order("3", "source_key", "step_index"), F.col("source_key"), F.col("step_index")])


@query(
    "quota_sample",
    """with s as (select o_orderpriority, count(*) as n from orders group by 1), lv as (select max(lev) as lev from (select unnest(range(0, (select max(n) + 1 from s))) as lev) where (select sum(least(n, lev)) from s) <= 300),
q as (select o_orderpriority, least(n, lev) + case when n > lev and row_number() over (partition by n > lev order by o_orderpriority) <= 300 - (select sum(least(n, lev)) from s, lv) then 1 else 0 end as quota from s, lv),
r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('5:' || o_orderpriority || ':' || o_orderkey), o_orderkey) as rn from orders)
select o_orderkey, o_orderpriority from r join q using (o_orderpriority) where rn <= quota""",
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even quotas for each annotation, 300 rows in all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    sizes = {r[0]: r[1] for r in rows.groupBy("o_orderpriority").count().collect()}  # one row for each file
    takes = spark.createDataFrame([*op.even_quotas(sizes, 300).items()], "o_orderpriority string, _take bigint")
    return op.top_by_hash(rows, "o_orderpriority", takes, [op.hash_order("5", "o_orderpriority", "o_orderkey"), F.col("o_orderkey")])
