"""Queries about splits, shards, mixing and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import sampling as op
from quillspark.operators.relations import table
from quillspark.operators.supervision import hash_order
from quillspark.plans.registry import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _by(seed: str) -> list:
    return [hash_order(seed, "o_orderkey"), F.col("o_orderkey")]


def _r(seed: str) -> str:
    return f"r as (select *, row_number() over (order by md5('{seed}:' || o_orderkey), o_orderkey) - 1 as p, count(*) over () as n from orders)"


@query("train_val_split", f"with {_r('42')} select o_orderkey, case when p < greatest(1, cast(trunc(n * 0.1) as bigint)) then 'val' else 'train' end as part from r")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth for validation."""
    return op.train_val(_orders(spark, sf_dir), 0.1, _by("42")).select("o_orderkey", "part")


@query("shuffled", f"with {_r('7')} select o_orderkey, p as position from r")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic shuffle."""
    return op.numbered(_orders(spark, sf_dir), _by("7")).select("o_orderkey", "position")


@query("chunk_list", f"with {_r('1')} select o_orderkey, ntile(7) over (order by p) - 1 as part from r")
def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven contiguous parts."""
    rows = op.numbered(_orders(spark, sf_dir), _by("1"))
    return rows.select("o_orderkey", op.chunk(F.col("position"), rows.count(), 7).alias("part"))


@query("strided_shards", f"with {_r('1')} select o_orderkey, p % 8 as rank, p // 8 as step from r where p < n // 8 * 8")
def strided_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to eight ranks; the rest is dropped."""
    rows = op.numbered(_orders(spark, sf_dir), _by("1"))
    n = rows.count() // 8 * 8
    return rows.where(F.col("position") < n).select("o_orderkey", (F.col("position") % 8).alias("rank"), F.expr("position div 8").alias("step"))


@query("range_piece", f"with {_r('1')} select o_orderkey, p as position from r where p >= n * 2 // 5 and p < n * 3 // 5")
def range_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of five pieces."""
    rows = op.numbered(_orders(spark, sf_dir), _by("1"))
    n = rows.count()
    return rows.where((F.col("position") >= n * 2 // 5) & (F.col("position") < n * 3 // 5)).select("o_orderkey", "position")


@query("repeat_sampling", "with c as (select *, row_number() over (order by md5('9:' || c_custkey), c_custkey) - 1 as p, count(*) over () as n from customer), t as (select *, n * 5 // 2 as target from c) select c_custkey, cast(unnest(range(1, target // n + case when p < target % n then 2 else 1 end)) as bigint) as copy from t")
def repeat_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and a half times the rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    n = rows.count()
    return op.repeat_to(rows, n, n * 5 // 2, [hash_order("9", "c_custkey"), F.col("c_custkey")]).select("c_custkey", F.col("copy").cast("bigint").alias("copy"))


@query("pad_to_divisor", f"with {_r('3')} select o_orderkey, p as position, false as padding from r union all select o_orderkey, p + n, true from r where p < (64 - n % 64) % 64")
def pad_to_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows padded to a multiple of 64."""
    rows = op.numbered(_orders(spark, sf_dir), _by("3")).select("o_orderkey", "position")
    return op.pad_to_divisor(rows, "position", rows.count(), 64)


@query("concat_aligned", "select c_custkey as key, c_name as name, null as price from customer union all by name select p_partkey as key, p_name as name, p_retailprice as price from part")
def concat_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in one, a missing column null."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return op.align([a, b])


@query("mixed_sources", """with d as (select doc_id, source, row_number() over (partition by source order by md5('6:' || doc_id), doc_id) - 1 as p from documents where source in ('src1', 'src2'))
select doc_id, source, case source when 'src1' then p // 3 * 4 + p % 3 else p * 4 + 3 end as slot from d where p < (select least(count(*) filter (source = 'src1') // 3, count(*) filter (source = 'src2')) from d) * case source when 'src1' then 3 else 1 end""")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources three to one, until the first is exhausted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    a, b = (op.numbered(docs.where(F.col("source") == s), [hash_order("6", "doc_id"), F.col("doc_id")], "p") for s in ("src1", "src2"))
    most = min(a.count() // 3, b.count())
    left = a.where(F.col("p") < 3 * most).select("doc_id", "source", F.expr("p div 3 * 4 + p % 3").alias("slot"))
    return left.unionByName(b.where(F.col("p") < most).select("doc_id", "source", (F.col("p") * 4 + 3).alias("slot")))


@query("length_groups", "with l as (select doc_id, length(text) as n, row_number() over (partition by length(text) // 256 order by length(text), doc_id) - 1 as p from documents) select doc_id, n // 256 as bucket, p // 16 as batch from l")
def length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of sixteen texts of like length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return rows.selectExpr("doc_id", "n div 256 as bucket", "cast((row_number() over (partition by n div 256 order by n, doc_id) - 1) div 16 as bigint) as batch")


@query("balanced_parts", "with l as (select doc_id, length(text) as n, row_number() over (order by length(text) desc, doc_id) - 1 as p from documents), s as (select *, case when p // 8 % 2 = 0 then p % 8 else 7 - p % 8 end as part from l) select part, count(*) as documents, cast(sum(n) as bigint) as chars from s group by 1")
def balanced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts of nearly equal size: lengths from the longest, dealt to and fro; places come from the histogram of lengths."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    before = rows.groupBy("n").agg(F.count("*").alias("c")).select("n", F.expr("sum(c) over (order by n desc) - c").alias("before"))
    placed = rows.withColumn("i", F.expr("row_number() over (partition by n order by doc_id) - 1")).join(before, "n")
    part = op.snake(F.col("before") + F.col("i"), 8)
    return placed.groupBy(part.alias("part")).agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


@query("token_budget_batches", "with l as (select doc_id, length(text) as n, sum(length(text)) over (partition by doc_id // 100 order by doc_id rows unbounded preceding) as upto from documents) select doc_id // 100 as shard, (upto - n) // 20000 as batch, count(*) as rows, cast(sum(n) as bigint) as chars from l group by 1, 2")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches by running size within shards."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 100 as shard", "cast(length(text) as bigint) as n")
    run = rows.selectExpr("shard", "n", "sum(n) over (partition by shard order by doc_id rows unbounded preceding) as upto")
    return run.groupBy("shard", F.expr("(upto - n) div 20000").alias("batch")).agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


@query("set_algebra", """with a as (select distinct o_custkey as k from orders where o_totalprice > 300000), b as (select distinct o_custkey as k from orders where o_orderstatus = 'F')
select (select count(*) from (select k from a intersect select k from b)) as both, (select count(*) from (select k from a except select k from b)) as only_a, (select count(*) from (select k from a union select k from b)) as either""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of two key sets, in one pass of flags."""
    flags = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    return flags.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("a") | F.col("b")).alias("either"))


@query("selected_ids", "select o_orderkey from orders semi join (select c_custkey from customer where c_mktsegment = 'BUILDING') c on o_custkey = c_custkey")
def selected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key was selected elsewhere."""
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, sf_dir, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("union_checked", "select c_custkey, c_acctbal, c_nationkey, sum(o_totalprice) as spent, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by 1, 2, 3")
def union_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables of the same keys side by side; a column of both must agree."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    other = c.join(spent, c.c_custkey == spent.o_custkey, "left").select("c_custkey", "c_nationkey", "spent", F.coalesce("n", F.lit(0)).alias("orders"))
    return op.union_checked(c, other, "c_custkey")


@query("truncated_windows", "with p as (select doc_id, unnest(range(0, greatest(1, (length(text) + 499) // 500))) as piece, text from documents) select doc_id, cast(piece as bigint) as piece, length(substring(text, piece * 500 + 1, 500)) as n, md5(substring(text, piece * 500 + 1, 500)) as digest from p")
def truncated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts as several rows of fixed windows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.expr("(length(text) + 499) div 500")).cast("int") - 1)).alias("piece"))
    cut = F.substring(F.col("text"), F.col("piece") * 500 + 1, F.lit(500))
    return rows.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.length(cut).cast("bigint").alias("n"), F.md5(cut.cast("binary")).alias("digest"))
