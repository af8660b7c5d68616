"""Queries about rewards, advantages and policy diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import advantages as op
from quillspark.operators.relations import REWARDS, SOURCES, STEPS, rewards, sources, steps, table
from quillspark.operators import rewards as rule
from quillspark.operators.evaluation import order_statistics
from quillspark.functions.labels import step_label
from quillspark.plans.registry import query

_G = f"{REWARDS}, g as (select *, avg(reward) over w as m, coalesce(stddev_samp(reward) over w, 0) as s, count(*) over w as n, sum(reward) over w as t from rewards window w as (partition by uid))"


@query("grpo_advantage", f"with {_G} select uid, item, (reward - m) / (s + 1e-6) as advantage from g")
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards normalised within groups."""
    return op.advantage(rewards(spark, sf_dir), "grpo")


@query("grpo_trainer_advantage", f"with {_G} select uid, item, (reward - m) / (s + 1e-4) as advantage from g")
def grpo_trainer_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the other epsilon."""
    return op.advantage(rewards(spark, sf_dir), "grpo_trainer")


@query("rloo_advantage", f"with {_G} select uid, item, reward - (t - reward) / nullif(n - 1, 0) as advantage from g")
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards less the mean of the others."""
    return op.advantage(rewards(spark, sf_dir), "rloo")


@query("batch_advantage", f"with {_G} select uid, item, (reward - m) / ((select stddev_samp(reward) from rewards) + 1e-4) as advantage from g")
def batch_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means taken off, scaled by the whole batch's deviation."""
    rows = rewards(spark, sf_dir)
    centred = op.group_stats(rows).select("uid", "item", op.ESTIMATORS["mean_only"](F.col("reward")).alias("c"))
    return centred.crossJoin(F.broadcast(rows.agg(F.stddev_samp("reward").alias("s")))).select("uid", "item", (F.col("c") / (F.col("s") + 1e-4)).alias("advantage"))  # one row


@query("passk_advantage", f"with {_G}, r as (select *, row_number() over (partition by uid order by reward desc, item) as rn, max(reward) over (partition by uid) as best, nth_value(reward, 2) over (partition by uid order by reward desc, item rows between unbounded preceding and unbounded following) as second from g) select uid, item, case when rn = 1 then (best - coalesce(second, best)) / (s + 1e-6) else 0.0 end as advantage from r")
def passk_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the best row of a group gains."""
    return op.pass_k_advantage(rewards(spark, sf_dir))


@query(
    "multi_reward_advantage",
    f"""with {REWARDS}, x as (select uid, item, reward as r1, case when item % 5 <> 0 then item % 7 * 0.1 end as r2 from rewards), y as (select *, 0.7 * r1 + 0.3 * coalesce(r2, 0) as reward from x),
z as (select uid, item, 0.7 * (r1 - avg(r1) over w) / (coalesce(stddev_samp(r1) over w, 0) + 1e-8) + 0.3 * (coalesce(r2, 0) - avg(coalesce(r2, 0)) over w) / (coalesce(stddev_samp(coalesce(r2, 0)) over w, 0) + 1e-8) as v, reward from y window w as (partition by uid))
select uid, item, reward, round((v - (select avg(v) from z)) / ((select stddev_samp(v) from z) + 1e-8), 6) + 0.0 as advantage from z""",
)
def multi_reward_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weighted rewards (a missing one counts 0), each normalised in its group, then whitened over the batch."""
    rows = rewards(spark, sf_dir).withColumn("r1", F.col("reward")).withColumn("r2", F.when(F.col("item") % 5 != 0, F.col("item") % 7 * 0.1).otherwise(0.0))
    stats = rows.groupBy("uid").agg(*(f(c).alias(f"{c}_{n}") for c in ("r1", "r2") for n, f in (("m", F.avg), ("s", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))))
    z = rows.join(stats, "uid").select("uid", "item", (0.7 * F.col("r1") + 0.3 * F.col("r2")).alias("reward"), sum(w * (F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-8) for c, w in (("r1", 0.7), ("r2", 0.3))).alias("v"))
    whole = F.broadcast(z.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")))  # one row
    return z.crossJoin(whole).select("uid", "item", "reward", (F.round((F.col("v") - F.col("m")) / (F.col("s") + 1e-8), 6) + 0.0).alias("advantage"))


@query("online_filter", f"with {REWARDS} select uid, item, reward from rewards where uid in (select uid from rewards group by 1 having avg(reward) > 2.0 and avg(reward) < 3.0)")
def online_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose mean lies strictly between bounds."""
    return op.online_filter(rewards(spark, sf_dir), 2.0, 3.0)


@query("dynamic_sampling", f"with {REWARDS} select uid, item, reward from rewards where uid in (select uid from rewards group by 1 having stddev_samp(reward) > 0)")
def dynamic_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose rewards differ."""
    return op.dynamic_sampling(rewards(spark, sf_dir))


@query("reward_metrics", f"with {REWARDS} select count(*) as n, avg(reward) as mean, min(reward) as minimum, max(reward) as maximum, stddev_pop(reward) as std, 1 - var_samp(reward - item % 5) / (var_samp(reward) + 1e-5) as explained_variance from rewards")
def reward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of rewards and the variance that a stand-in value explains."""
    v = F.col("item") % 5
    return rewards(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.min("reward").alias("minimum"), F.max("reward").alias("maximum"), F.stddev_pop("reward").alias("std"), (1 - F.var_samp(F.col("reward") - v) / (F.var_samp("reward") + 1e-5)).alias("explained_variance"))


_TOKENS = """tok as (select l_orderkey as seq, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_shipdate, l_discount, l_returnflag, l_linestatus) - 1 as t, -l_discount * 3 as logp, -l_tax * 4 as old, l_quantity / 50 as r, case when l_returnflag <> 'R' then 1 else 0 end as mask from lineitem)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, t, logp, old, r, mask: tokens of sequences."""
    from pyspark.sql import Window as W

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_shipdate", "l_discount", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"), (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1).alias("t"), (-F.col("l_discount") * 3).alias("logp"), (-F.col("l_tax") * 4).alias("old"),
        (F.col("l_quantity") / 50).alias("r"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"),
    )


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", "r", "logp", "old", "mask"))).alias("x"))
    return rows.select("seq", F.col("x.r").alias("r"), F.col("x.logp").alias("logp"), F.col("x.old").alias("old"), F.col("x.mask").alias("mask"))


@query("token_kl", f"with {_TOKENS}, d as (select *, greatest(-20.0, least(20.0, old - logp)) as k from tok) select seq, t, logp - old as kl, abs(logp - old) as abs_kl, 0.5 * (logp - old) * (logp - old) as mse, greatest(-10.0, least(10.0, exp(k) - k - 1)) as low_var_kl from d")
def token_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence estimates of each token."""
    rows = _tokens(spark, sf_dir)
    a, b = F.col("logp"), F.col("old")
    return rows.select("seq", "t", op.token_kl(a, b, "kl").alias("kl"), op.token_kl(a, b, "abs").alias("abs_kl"), op.token_kl(a, b, "mse").alias("mse"), op.token_kl(a, b, "low_var_kl").alias("low_var_kl"))


@query(
    "importance_weights",
    f"""with {_TOKENS}, s as (select seq, exp(coalesce(sum((logp - old) * mask), 0) / greatest(sum(mask), 1)) as sr from tok group by 1)
select seq, t, least(exp(logp - old), 1.05) as token_truncate, case when exp(logp - old) <= 1.05 then exp(logp - old) else 0.0 end as token_mask, least(sr, 1.05) as sequence_truncate, case when sr <= 1.05 then exp(logp - old) else 0.0 end as sequence_mask from tok join s using (seq)""",
)
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction weights in four modes."""
    rows = _tokens(spark, sf_dir)
    ratio = F.exp(op.clamp(F.col("logp") - F.col("old"), -20.0, 20.0))
    seq = rows.groupBy("seq").agg(F.exp(F.sum((F.col("logp") - F.col("old")) * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("sr"))
    return rows.join(seq, "seq").select("seq", "t", *(op.importance(ratio, F.col("sr"), m, 1.05).alias(m) for m in ("token_truncate", "token_mask", "sequence_truncate", "sequence_mask")))


@query(
    "policy_diagnostics",
    f"""with {_TOKENS}, l as (select logp - old as d, exp(logp - old) as w, mask from tok where mask = 1), m as (select avg(least(w, 2.0)) as mw from l)
select avg(d) as kl, avg(exp(-d) + d - 1) as k3, avg(w * w) - 1 as chi2_token, avg(least(w, 2.0)) as mean_weight, 1 / avg(least(w, 2.0) / mw * least(w, 2.0) / mw) as ess, avg(case when w > 1.1 then 1.0 else 0.0 end) as clipped_frac from l, m""",
)
def policy_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-policy diagnostics over unmasked tokens, in one pass: the effective sample size from the first two moments."""
    d = F.col("logp") - F.col("old")
    w, c = F.exp(d), F.least(F.exp(d), F.lit(2.0))
    return _tokens(spark, sf_dir).where("mask = 1").agg(
        F.avg(d).alias("kl"), F.avg(F.exp(-d) + d - 1).alias("k3"), (F.avg(w * w) - 1).alias("chi2_token"), F.avg(c).alias("mean_weight"), (F.avg(c) * F.avg(c) / F.avg(c * c)).alias("ess"), F.avg(F.when(w > 1.1, 1.0).otherwise(0.0)).alias("clipped_frac"),
    )


@query(
    "off_policy_mask",
    f"""with {_TOKENS}, s as (select seq, sum((old - logp) * mask) / greatest(sum(mask), 1) as d, avg(r) - 0.5 as adv from tok group by 1) select seq, d as divergence, adv as advantage, not (d > 0.05 and adv < 0) as kept from s""",
)
def off_policy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences far from the old policy (mean over unmasked tokens; 0 if there is none) with a negative advantage drop out."""
    far = F.sum((F.col("old") - F.col("logp")) * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))
    s = _tokens(spark, sf_dir).groupBy("seq").agg(far.alias("divergence"), (F.avg("r") - 0.5).alias("advantage"))
    return s.withColumn("kept", ~((F.col("divergence") > 0.05) & (F.col("advantage") < 0)))


@query(
    "policy_losses",
    f"""with {_TOKENS}, a as (select *, exp(logp - old) as w, r - 0.5 as adv from tok), l as (select seq, greatest(-adv * w, -adv * greatest(0.8, least(1.2, w))) as loss, mask, w > 1.2 or w < 0.8 as clipped from a),
q as (select seq, coalesce(sum(loss * mask) / nullif(sum(mask), 0), 0) as m from l group by 1) select sum(loss * mask) / sum(mask) as token_mean, (select avg(m) from q) as sequence_mean, avg(case when clipped then 1.0 else 0.0 end) as clip_frac from l""",
)
def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clipped objective's value, averaged over tokens and over sequences."""
    adv, w = F.col("r") - 0.5, F.exp(F.col("logp") - F.col("old"))
    rows = _tokens(spark, sf_dir).select("seq", "mask", F.greatest(-adv * w, -adv * op.clamp(w, 0.8, 1.2)).alias("loss"), ((w > 1.2) | (w < 0.8)).alias("clipped"))
    seq = rows.groupBy("seq").agg(F.sum(F.col("loss") * F.col("mask")).alias("l"), F.sum("mask").alias("m"), F.count("*").alias("n"), F.count_if("clipped").alias("c"))
    return seq.agg((F.sum("l") / F.sum("m")).alias("token_mean"), F.avg(F.coalesce(F.try_divide("l", "m"), F.lit(0.0))).alias("sequence_mean"), (F.sum("c") / F.sum("n")).alias("clip_frac"))


@query("discounted_returns", f"""with {_TOKENS}, z as (select *, sum(1 - mask) over (partition by seq order by t) as k from tok) select a.seq, a.t, round(sum(b.r * pow(0.9, b.t - a.t)), 6) as ret from z a join z b on a.seq = b.seq and b.t >= a.t and (b.k = a.k or (b.t = a.t)) group by 1, 2""")
def discounted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted returns that start anew before a masked token."""
    rows = _sequences(spark, sf_dir).select("seq", F.posexplode(op.discounted(F.col("r"), F.col("mask"), 0.9)).alias("t", "ret"))
    return rows.select("seq", "t", F.round("ret", 6).alias("ret"))


@query(
    "gae",
    f"""with {_TOKENS}, v as (select *, old + 1 as val, lead(old + 1, 1, 0) over (partition by seq order by t) as nv from tok), d as (select *, r + 0.99 * nv - val as delta from v)
select a.seq, a.t, round(sum(b.delta * pow(0.99 * 0.95, b.t - a.t)) + 1e-9, 5) as advantage from d a join d b on a.seq = b.seq and b.t >= a.t group by 1, 2""",
)
def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages of sequences without masked tokens."""
    rows = _sequences(spark, sf_dir)
    ones, values = F.transform("mask", lambda m: F.lit(1)), F.transform("old", lambda v: v + 1)
    out = rows.select("seq", F.posexplode(op.gae(F.col("r"), values, ones, 0.99, 0.95)).alias("t", "advantage"))
    return out.select("seq", "t", F.round(F.col("advantage") + 1e-9, 5).alias("advantage"))


@query("masked_whiten", f"with {_TOKENS}, m as (select sum(r * mask) / sum(mask) as mean, var_samp(r) filter (mask = 1) as var from tok) select seq, t, (r - mean) / sqrt(var + 1e-8) as whitened from tok, m")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less the mean and over the deviation of unmasked tokens."""
    rows = _tokens(spark, sf_dir)
    own = F.when(F.col("mask") == 1, F.col("r"))
    stats = F.broadcast(rows.agg(F.avg(own).alias("mean"), F.var_samp(own).alias("var")))  # one row
    return rows.crossJoin(stats).select("seq", "t", ((F.col("r") - F.col("mean")) / F.sqrt(F.col("var") + 1e-8)).alias("whitened"))


@query("kl_in_reward", f"with {_TOKENS} select seq, sum(r - 0.05 * abs(logp - old) * mask) as score, sum(abs(logp - old) * mask) / greatest(sum(mask), 1) as mean_kl from tok group by 1")
def kl_in_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence rewards less their divergence."""
    kl = op.token_kl(F.col("logp"), F.col("old"), "abs") * F.col("mask")
    return _tokens(spark, sf_dir).groupBy("seq").agg(F.sum(F.col("r") - 0.05 * kl).alias("score"), (F.sum(kl) / F.greatest(F.sum("mask"), F.lit(1))).alias("mean_kl"))


@query("length_metrics", "with s as (select l_orderkey, count(*) as n from lineitem group by 1) select avg(n) as mean, max(n) as longest, min(n) as shortest, avg(case when n >= 8 then 1.0 else 0.0 end) as clip_ratio from s")
def length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of sequences and the share at the limit."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return s.agg(F.avg("n").alias("mean"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.avg(F.when(F.col("n") >= 8, 1.0).otherwise(0.0)).alias("clip_ratio"))


#: Labels of the first six steps of a source; predictions beyond are of steps that nobody asked for.
_ASKED = 6
_LABELLED = f"""l as (select source_key, step_index, case when step_index < {_ASKED} then case when score <= 0.125 then 0 when score >= 0.75 then 1 else -1 end end as label, case when pred in (0, 1) then pred end as pred from steps)"""
_COUNTS = "c as (select source_key, count(label) as targets, count(*) filter (label is not null and pred is null) as missing, count(*) filter (label is null and pred is not null) as extra, " + ", ".join(
    f"count(*) filter (label = {k}) as has{k}, count(*) filter (label = {k} and pred = {k}) as hit{k}, count(*) filter (label = {1 - k} and pred = {k}) as wrong{k}, count(*) filter (label is null and pred = {k}) as extra{k}" for k in (0, 1)
) + " from l group by 1)"
_F = ", ".join(f"case when has{k} + extra{k} > 0 then coalesce(2.0 * hit{k} / nullif(hit{k} + has{k} + wrong{k} + extra{k}, 0), 0) end as f{k}" for k in (0, 1))
_METRICS = f"""f as (select *, {_F}, has0 + has1 as confident, greatest(0.0, 1.0 - (extra + missing) / cast(greatest(targets, 1) as double)) as cnt from c),
g as (select *, list_avg(list_filter([f0, f1], lambda x: x is not null)) as raw, least(list_avg(list_filter([f0, f1], lambda x: x is not null)), cnt) as mf, coalesce(hit0 / nullif(cast(has0 as double), 0), 0) as na, coalesce(hit1 / nullif(cast(has1 as double), 0), 0) as pa from f),
m as (select source_key, """ + ", ".join(
    f"round(case when confident = 0 then 0.0 else {sql} end, 9) as {n}" for n, sql in {
        "step": "0.95 * mf + 0.05 * cnt", "accuracy": "(hit0 + hit1) / cast(confident as double)", "macro_f1": "mf", "raw_macro_f1": "raw", "negative_f1": "coalesce(f0, 0)", "positive_f1": "coalesce(f1, 0)",
        "balanced_accuracy": "(na + pa) / ((has0 > 0)::int + (has1 > 0)::int)", "negative_accuracy": "na", "positive_accuracy": "pa", "pred_negative_ratio": "(hit0 + wrong0) / cast(confident as double)",
    }.items()
) + """, round(cnt, 9) as "count", cast(targets - missing + extra as double) as parsed_steps, cast(targets as double) as target_steps, cast(extra as double) as extra_steps, cast(missing as double) as missing_steps from g)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("step_index") < _ASKED, F.coalesce(step_label(F.col("score"), uncertain=-1), F.lit(-1)))
    return steps(spark, sf_dir).select("source_key", "step_index", label.alias("label"), F.when(F.col("pred").isin(0, 1), F.col("pred")).alias("pred"))


def _rounded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, *((F.round(c, 9) if c not in ("parsed_steps", "target_steps", "extra_steps", "missing_steps") else F.col(c)).alias(c) for c in rule.STEP_OUTPUTS))


@query("reward_source_macro", f"with {STEPS}, {_LABELLED}, {_COUNTS}, {_METRICS} select * from m")
def reward_source_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step part of the source-level reward, all fifteen outputs, from counts of step rows."""
    return _rounded(rule.step_metrics(rule.step_counts(_labelled(spark, sf_dir), "source_key")), "source_key")


@query("class_f1_by_source", f"with {STEPS}, {_LABELLED}, {_COUNTS} select source_key, {_F.replace('as f0', 'as negative_f1').replace('as f1', 'as positive_f1')} from c")
def class_f1_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each class in each source, steps that were not asked for counted; null where the class is absent."""
    return rule.step_counts(_labelled(spark, sf_dir), "source_key").select("source_key", rule.class_f1(0).alias("negative_f1"), rule.class_f1(1).alias("positive_f1"))


_KIND = "source_key % 6"
_FIRST = "coalesce(list_position(labels, 0), 0) - 1"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, labels, response: six forms of a response around the predictions of a source."""
    rows = _labelled(spark, sf_dir).groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("step_index", "label", "pred"))).alias("x"))
    labels = F.filter(F.col("x.label"), lambda v: v.isNotNull())
    lines = F.array_join(F.transform(F.filter("x", lambda e: e["pred"].isNotNull()), lambda e: F.concat(F.lit("- Step "), e["step_index"].cast("string"), F.lit(": \\boxed{"), e["pred"].cast("string"), F.lit("}"))), "\n")
    listed = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: F.coalesce(e["pred"].cast("string"), F.lit('"1"'))), ", "), F.lit("]"))
    named = F.concat(F.lit("{"), F.array_join(F.transform(F.filter("x", lambda e: e["pred"].isNotNull()), lambda e: F.concat(F.lit('"step '), e["step_index"].cast("string"), F.lit('": '), e["pred"].cast("string"))), ", "), F.lit("}"))
    first = (F.array_position(F.transform("x", lambda e: F.coalesce(e["pred"], F.lit(-2))), 0) - 1).cast("string")
    think = F.repeat(F.lit("because "), (F.col("source_key") % 400).cast("int"))
    body = F.concat(F.lit("<think>"), think, F.lit("</think>"))
    answer = lambda a: F.concat(F.lit("\n<answer>"), a, F.lit("</answer>"))
    kind = F.col("source_key") % 6
    response = (
        F.when(kind == 0, F.concat(body, answer(F.concat(lines, F.lit("\nFirstError: "), first)))).when(kind == 1, F.concat(F.lit("<think>"), think, answer(lines))).when(kind == 2, F.concat(body, answer(listed)))
        .when(kind == 3, body).when(kind == 4, F.concat(F.lit("So: "), body, answer(F.concat(lines, F.lit("\nFirstError: "), first)))).otherwise(F.concat(body, answer(named)))
    )
    return rows.select("source_key", labels.alias("labels"), response.alias("response"))


_ANSWERED = f"""r as (select source_key, list(label order by step_index) filter (label is not null) as labels, coalesce(list_position(list(coalesce(pred, -2) order by step_index), 0), 0) - 1 as declared, bool_or(pred is not null) as given from l group by 1),
a as (select l.source_key, step_index, label, case when {_KIND.replace('source_key', 'l.source_key')} <> 3 then pred end as pred from l)"""
_FORMATS = """q as (select source_key, labels, declared, source_key % 6 as kind, source_key % 6 in (0, 2, 4, 5) or (source_key % 6 = 1 and given) as answered, case when source_key % 6 = 1 then 0 else greatest(8 * (source_key % 400) - 1, 0) end as tn from r),
s as (select *, cast(case when kind in (0, 2, 5) then case when tn > 0 and answered then 1.0 else 0.5 end
  else least(0.8, (case when tn > 0 then 0.3 else 0 end) + (case when answered then 0.4 else 0 end) + (case when kind <> 4 then 0.15 else 0 end) + (case when kind <> 3 then 0.15 else 0 end)) end as double) as fmt from q)"""


def _think(n: str, most: int) -> str:
    return f"case when {n} = 0 then 0.0 when {n} < 80 then {n} / 80.0 when {n} > {most} then greatest(0.0, 1.0 - ({n} - {most}) / {most}.0) else 1.0 end"


_ANSWER_COUNTS = _COUNTS.replace(" from l group", " from a group")


@query("response_rewards", f"with {STEPS}, {_LABELLED}, {_ANSWERED}, {_ANSWER_COUNTS}, {_METRICS}, {_FORMATS} select m.*, round(fmt, 9) as format, round({_think('tn', 1800)}, 9) as think, round(0.92 * step + 0.05 * fmt + 0.03 * {_think('tn', 1800)}, 7) as overall from m join s using (source_key)")
def response_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses, parsed and scored: blocks, steps as lines, lists and objects, and the weighted overall."""
    done = rule.response_rewards(_responses(spark, sf_dir))
    return _rounded(done, "source_key", F.round("format", 9).alias("format"), F.round("think", 9).alias("think"), F.round("overall", 7).alias("overall"))


_LOCAL = f"case when kind in (0, 4) and declared = {_FIRST} and declared < len(labels) then 1::double else 0::double end"
_STEP_15 = "case when confident = 0 then 0.0 else 0.85 * mf + 0.15 * cnt end"


@query(
    "localize_reward",
    f"""with {STEPS}, {_LABELLED}, {_ANSWERED}, {_ANSWER_COUNTS}, {_METRICS}, {_FORMATS}, z as (select g.source_key, {_LOCAL} as localize, case when kind in (0, 4) then declared else -1 end as first_error_pred, {_FIRST} as first_error_target, case when kind in (0, 4) then round(least(1.0, fmt + 0.05), 9) else round(fmt, 9) end as format,
case when confident = 0 then 0.0 else mf end as mf, {_STEP_15} as step, {_think('tn', 2400)} as think from g join s using (source_key))
select source_key, localize, cast(first_error_pred as double) as first_error_pred, cast(first_error_target as double) as first_error_target, format, round(least(mf, localize), 9) as cons, round(0.75 * step + 0.2 * least(mf, localize) + 0.04 * format + 0.01 * think, 7) as overall from z""",
)
def localize_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards with the declared first error: right or not, and counted only as far as the steps support it."""
    done = rule.response_rewards(_responses(spark, sf_dir), localized=True)
    return done.select("source_key", "localize", "first_error_pred", "first_error_target", F.round("format", 9).alias("format"), F.round("cons", 9).alias("cons"), F.round("overall", 7).alias("overall"))


@query(
    "entropy_order",
    """with p as (select user_id as item, avg(case when event_type in ('purchase', 'signup') then 1.0 else 0.0 end) as p, avg(case when value > 50 then 1.0 else 0.0 end) as acc from events group by 1),
e as (select *, greatest(1e-6, least(1 - 1e-6, p)) as q from p), u as (select item, acc, -(q * ln(q) + (1 - q) * ln(1 - q)) / ln(2) as uncertainty from e)
select item, round(uncertainty, 9) as uncertainty, acc as accuracy from u order by round(uncertainty, 9) desc, acc, md5('1:' || item), item limit 40""",
)
def entropy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty items of greatest uncertainty."""
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(F.avg(F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0)).alias("p"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("accuracy"))
    q = op.clamp(F.col("p"), 1e-6, 1 - 1e-6)
    u = F.round(-(q * F.log(q) + (1 - q) * F.log(1 - q)) / F.log(F.lit(2.0)), 9)
    rows = p.select("item", u.alias("uncertainty"), "accuracy")
    return rows.orderBy(F.desc("uncertainty"), "accuracy", F.md5(F.concat(F.lit("1:"), F.col("item").cast("string"))), "item").limit(40)


@query("upper_median", "select event_type, max(v) filter (rn = n // 2 + 1) as upper_median, count(*) as n from (select event_type, value as v, row_number() over (partition by event_type order by value, event_id) as rn, count(*) over (partition by event_type) as n from events) group by 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at half the count, which is not interpolated."""
    return order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", {"upper_median": "n div 2"})


@query(
    "response_mask",
    f"""with {_TOKENS}, e as (select *, case when r > 0.9 then 1 else 0 end as eos from tok) select seq, t, case when sum(eos) over (partition by seq order by t) - eos = 0 then 1 else 0 end as mask from e""",
)
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 up to and with the first end token."""
    rows = _sequences(spark, sf_dir).select("seq", F.transform("r", lambda x: F.when(x > 0.9, 1).otherwise(0)).alias("eos"))
    at = F.array_position("eos", 1)
    return rows.select("seq", F.posexplode(F.transform("eos", lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))).alias("t", "mask"))


@query(
    "remax_returns",
    f"""with {_TOKENS}, s as (select seq, sum(r) - 0.5 as adv from tok group by 1) select seq, t, round(sum(r * mask) over (partition by seq order by t desc rows unbounded preceding), 6) + 0.0 as ret, round(adv * mask, 6) + 0.0 as advantage from tok join s using (seq)""",
)
def remax_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of later unmasked rewards; the baseline is taken off the advantage alone, which is the same for all unmasked tokens."""
    rows = _tokens(spark, sf_dir)
    total = rows.groupBy("seq").agg((F.sum("r") - 0.5).alias("adv"))
    ret = F.expr("sum(r * mask) over (partition by seq order by t desc rows unbounded preceding)")
    return rows.withColumn("ret", ret).join(total, "seq").select("seq", "t", (F.round("ret", 6) + 0.0).alias("ret"), (F.round(F.col("adv") * F.col("mask"), 6) + 0.0).alias("advantage"))
