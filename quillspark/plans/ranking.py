"""Queries about embeddings, rankings and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vectors
from quillspark.operators.advantages import islands
from quillspark.operators.evaluation import average_ranks
from quillspark.operators.relations import table
from quillspark.plans.registry import query

_E = "e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), p as (select a.vec_id // 2 as pair, a.v as x, b.v as y, case when a.label = b.label then 1.0 else 0.0 end as gold from e a join e b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1)"
_SIM = "s as (select pair, gold, list_cosine_similarity(x, y) as cosine, list_inner_product(x, y) as dot, -list_distance(x, y) as euclidean, -list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) as manhattan from p)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), F.col("v").alias("x"), F.col("label").alias("la"))
    b = e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), F.col("v").alias("y"), F.col("label").alias("lb"))
    p = a.join(b, "pair").withColumn("gold", F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0))
    x, y = F.col("x"), F.col("y")
    return p.select("pair", "gold", vectors.cosine(x, y).alias("cosine"), vectors.dot(x, y).alias("dot"), (-vectors.euclidean(x, y)).alias("euclidean"), (-vectors.manhattan(x, y)).alias("manhattan"))


@query("paired_similarity", f"with {_E}, {_SIM} select pair, gold, round(cosine, 6) + 0.0 as cosine, round(dot, 6) + 0.0 as dot, round(euclidean, 6) + 0.0 as euclidean, round(manhattan, 6) + 0.0 as manhattan from s")
def paired_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four similarities of each pair of vectors."""
    return _pairs(spark, sf_dir).select("pair", "gold", *((F.round(c, 6) + 0.0).alias(c) for c in ("cosine", "dot", "euclidean", "manhattan")))


_KINDS = ["cosine", "dot", "euclidean", "manhattan"]


@query("similarity_correlation", f"with {_E}, {_SIM}, k as (select *, " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}" for c in [*_KINDS, "gold"]) + " from s) select " + ", ".join(f"round(corr({c}, gold), 6) as pearson_{c}, round(corr(r_{c}, r_gold), 6) as spearman_{c}" for c in _KINDS) + ", count(*) as pairs from k")
def similarity_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman agreement of each similarity and the label.

    Ranks come from counts of equal values, numbered within ranges of the value and over the
    ranges' counts, so that no task puts all pairs in order.
    """
    s = _pairs(spark, sf_dir).select("pair", *_KINDS, "gold")
    # one row for each pair and measure, so that all ranks are taken in one go
    values = s.select("pair", F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("v")) for c in [*_KINDS, "gold"]))))
    ranked = average_ranks(values, "kind", "v")
    wide = ranked.groupBy("pair").agg(*(F.max(F.when(F.col("kind") == c, F.col(x))).alias(f"{p}{c}") for c in [*_KINDS, "gold"] for x, p in (("v", ""), ("r", "r_"))))
    both = [x for c in _KINDS for x in (F.round(F.corr(c, "gold"), 6).alias(f"pearson_{c}"), F.round(F.corr(f"r_{c}", "r_gold"), 6).alias(f"spearman_{c}"))]
    return wide.agg(*both, F.count("*").alias("pairs"))


@query("contrastive_loss", f"with {_E}, {_SIM} select round(avg(0.5 * (gold * (1 - cosine) * (1 - cosine) + (1 - gold) * pow(greatest(0.5 - (1 - cosine), 0), 2))), 6) as contrastive, round(avg((cosine - gold) * (cosine - gold)), 6) as cosine_mse from s")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss values of pairs."""
    d, g = 1 - F.col("cosine"), F.col("gold")
    hinge = F.greatest(0.5 - d, F.lit(0.0))
    return _pairs(spark, sf_dir).agg(F.round(F.avg(0.5 * (g * d * d + (1 - g) * hinge * hinge)), 6).alias("contrastive"), F.round(F.avg((F.col("cosine") - g) * (F.col("cosine") - g)), 6).alias("cosine_mse"))


_RANKS = """b as (select event_id as pos, case when event_type = 'purchase' then 1 else 0 end as label, value as logit from events), g as (select *, sum(label) over (order by pos) as island from b),
r as (select island, label, row_number() over (partition by island order by logit desc, pos) as rank, count(*) over (partition by island) as n from g where island > 0)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that begin at each positive row; rows before the first are dropped."""
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), F.col("value").alias("logit"))
    return islands(b, "pos", F.col("label") == 1).where("island > 0")


@query("mrr_ndcg", f"with {_RANKS} select round(avg(1.0 / rank), 9) as mrr, round(avg(1 / log2(rank + 1)), 9) as ndcg, count(*) as groups from r where label = 1 and n > 1")
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How high the positive row of each group of two or more ranks."""
    rows = _ranked(spark, sf_dir)
    top = rows.where("label = 1").select("island", F.col("logit").alias("top"), F.col("pos").alias("at"))
    ahead = (F.col("logit") > F.col("top")) | ((F.col("logit") == F.col("top")) & (F.col("pos") < F.col("at")))
    r = rows.join(top, "island").groupBy("island").agg((F.count_if(ahead) + 1).alias("rank"), F.count("*").alias("n")).where("n > 1")
    return r.agg(F.round(F.avg(1.0 / F.col("rank")), 9).alias("mrr"), F.round(F.avg(1 / F.log2(F.col("rank") + 1)), 9).alias("ndcg"), F.count("*").alias("groups"))


@query("listwise_loss", f"with {_RANKS.replace('row_number', 'row_number')}, s as (select island, max(logit) filter (label = 1) - max(logit) - ln(sum(exp(logit - m))) as lp, count(*) as n from (select *, max(logit) over (partition by island) as m from g where island > 0) group by island) select round(avg(-lp), 6) as loss, count(*) as groups from s where n > 1")
def listwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy of the positive row in each group."""
    rows = _ranked(spark, sf_dir)
    most = rows.groupBy("island").agg(F.max("logit").alias("m"))
    s = rows.join(most, "island").groupBy("island").agg((F.max(F.when(F.col("label") == 1, F.col("logit"))) - F.max("m") - F.log(F.sum(F.exp(F.col("logit") - F.col("m"))))).alias("lp"), F.count("*").alias("n")).where("n > 1")
    return s.agg(F.round(F.avg(-F.col("lp")), 6).alias("loss"), F.count("*").alias("groups"))


@query("best_worst_pairs", """with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as hi, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey desc) as lo, count(*) over (partition by o_custkey) as n from orders)
select a.o_custkey, a.o_orderkey as chosen, b.o_orderkey as rejected, a.hi as rank from r a join r b on a.o_custkey = b.o_custkey and b.lo = 1 and a.hi <= 2 and a.n > 2""")
def best_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best rows of a group, each with the worst: a bounded list of the best is merged, not sorted whole."""
    rows = table(spark, sf_dir, "orders")
    best = F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("k"))
    g = rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", best).alias("first"), F.min_by("o_orderkey", best).alias("rejected"), F.count("*").alias("n")).where("n > 2")
    rest = rows.join(g, "o_custkey").where("o_orderkey <> first").groupBy("o_custkey").agg(F.max_by("o_orderkey", best).alias("second"))
    both = g.join(rest, "o_custkey").select("o_custkey", "rejected", F.posexplode(F.array("first", "second")).alias("i", "chosen"))
    return both.select("o_custkey", "chosen", "rejected", (F.col("i") + 1).cast("bigint").alias("rank"))


@query("minmax_mix", "with g as (select o_custkey, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1) select o_orderkey, case when hi = lo then 1.0 else (o_totalprice - lo) / (hi - lo) end + 10 * case when o_orderstatus = 'F' then 1.0 else 0.0 end as mixed from orders join g using (o_custkey)")
def minmax_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores scaled within groups (1 where all are equal), mixed with a rule score."""
    rows = table(spark, sf_dir, "orders")
    g = rows.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return rows.join(g, "o_custkey").select("o_orderkey", (scaled + 10 * F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("mixed"))


@query("label_agreement", "select l.quality, l.toxic, count(*) as n, avg(case when l.quality = case when length(d.text) > 500 then 1 else 0 end then 1.0 else 0.0 end) as accuracy from labels l join documents d using (doc_id) group by 1, 2")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-match accuracy of a length rule by label."""
    guess = F.when(F.length("text") > 500, 1).otherwise(0)
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg(F.when(F.col("quality") == guess, 1.0).otherwise(0.0)).alias("accuracy"))


@query("token_accuracy", """with t as (select l_orderkey as seq, l_linenumber % 5 as label, l_suppkey % 5 as pred, l_returnflag <> 'R' as counted from lineitem) select avg(case when label = pred then 1.0 else 0.0 end) filter (counted) as token_accuracy,
(select avg(case when ok then 1.0 else 0.0 end) from (select seq, bool_and(label = pred or not counted) as ok from t group by 1 having bool_or(counted))) as sequence_accuracy from t""")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of counted tokens and of sequences all of whose counted tokens are right; partial sums meet by sequence."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_linenumber") % 5 == F.col("l_suppkey") % 5).alias("right"), (F.col("l_returnflag") != "R").alias("counted"))
    s = t.groupBy("seq").agg(F.count_if("counted").alias("n"), F.count_if(F.col("right") & F.col("counted")).alias("k"))
    return s.agg((F.sum("k") / F.sum("n")).alias("token_accuracy"), F.avg(F.when(F.col("n") > 0, F.when(F.col("n") == F.col("k"), 1.0).otherwise(0.0))).alias("sequence_accuracy"))
