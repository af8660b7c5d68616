"""Document fingerprints (operator 5) by consistent weighted sampling, in DataFrame functions alone.

A document's terms are its words, weighted by how often they occur.  For each of
`SAMPLES` samples and each term, a hash gives r and c ~ Gamma(2, 1) and beta ~ U(0, 1);
with weight w, t = floor(ln w / r + beta) and ln a = ln c - r (t - beta + 1).  The sample is
the term and t of least a: two documents agree in a sample with a probability equal to
their generalised Jaccard similarity (sum of the lesser weights over sum of the greater).
As a depends on nothing but term, sample and t, its least value names both, and a
fingerprint is 16 bits of a hash of it for each sample.

Everything is columns and aggregates: words are exploded where the documents' text lies,
partitioned by doc_id, counted for each document, and each sample is a `min` over the
document's terms, taken `PART` samples at a time.  A text and its edited text share the words
before the edit, so both are sampled in one pass, and a term as frequent in both only once.

The next document is found on ids alone: in blocks of doc_id, with the blocks' least ids in
order for their last rows, so that no task sorts all ids.

Edge cases: null text counts as empty; an empty text has no terms, a fingerprint of its own,
and likeness 1 to another empty text; rows that share a doc_id have the same next document,
the one of next greater doc_id (if that has several rows, its first text in order); a single
document is its own next; a null doc_id sorts before all; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import save, table

SAMPLES = 64
PART = 32  # samples of one aggregate: Spark cannot compile one of 64 for both texts
BLOCK_ROWS = 10_000
_SPLIT = r"[\x20\x09-\x0D]+"


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id (distinct) and next_id: the next greater one, and after the greatest the least."""
    ids = ids.select("doc_id").distinct()
    lo, hi, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if n == 0:
        return ids.withColumn("next_id", F.col("doc_id"))
    per_block = max(BLOCK_ROWS, int(n**0.5))
    width = max(1, ((hi or 0) - (lo or 0) + 1) * per_block // n)
    blocked = ids.withColumn("block", F.coalesce(F.expr(f"(doc_id - ({lo or 0})) div {width}"), F.lit(-1)))
    inner = blocked.withColumn("next_id", F.expr("lead(doc_id) over (partition by block order by doc_id nulls first)"))
    inner = inner.withColumn("last", F.expr("row_number() over (partition by block order by doc_id desc nulls last) = 1"))
    heads = blocked.groupBy("block").agg(F.min("doc_id").alias("head"))
    after = heads.select("block", F.expr("coalesce(lead(head) over (order by block), first(head) over (order by block))").alias("after"))
    return inner.join(after, "block").select("doc_id", F.when(F.col("last"), F.col("after")).otherwise(F.col("next_id")).alias("next_id"))


#: Stands for a null doc_id in joins, so that rows stay dealt out by the key; no id may be this.
_NO_ID = -(1 << 63)


def edited_texts(docs: DataFrame) -> DataFrame:
    """key, next_id, text, edited of every row, dealt out by key (doc_id, or a stand-in for null): the last quarter replaced by the next document's first characters."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("key")
    texts = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))  # the same columns for both joins, so that the text is dealt out once
    sizes = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    wants = sizes.groupBy("doc_id").agg(F.expr("cast(max(n) div 4 as int)").alias("take"))
    wants = next_ids(sizes).alias("x").join(wants.alias("w"), F.expr("x.doc_id <=> w.doc_id"))
    wants = save(wants.selectExpr(f"coalesce(x.doc_id, cast({_NO_ID} as bigint)) as before", f"coalesce(x.next_id, cast({_NO_ID} as bigint)) as after", "w.take as take"), "next")
    heads = texts.join(wants, F.expr("key = after")).select("before", "after", F.expr("substring(text, 1, take)").alias("head"))
    heads = heads.groupBy("before", "after").agg(F.min("head").alias("head"))
    both = texts.join(heads, F.expr("key = before"))
    keep = "length(text) - length(text) div 4"
    return both.selectExpr("key", "after as next_id", "text", f"concat(substring(text, 1, cast({keep} as int)), substring(head, 1, cast(length(text) div 4 as int))) as edited")


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from `width` bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-width)


def samples(texts: DataFrame, k: int = SAMPLES) -> DataFrame:
    """key, doc_id, next_id, n_chars, edited_sha256, s (samples of the text), e (of the edited text); texts is from edited_texts()."""
    # the words that both texts have: those before the last white space in what is kept
    kept = "substring(text, 1, cast(length(text) - length(text) div 4 as int))"
    rows = texts.selectExpr("key", "next_id", "monotonically_increasing_id() as row", "cast(length(text) as bigint) as n_chars", "sha2(cast(edited as binary), 256) as sha", f"regexp_extract({kept}, '(?s)^.*[\\\\x20\\\\x09-\\\\x0D]', 0) as both", "text", "edited")
    rows = rows.selectExpr(
        "key", "next_id", "row", "n_chars", *(f"cast(conv(substring(sha, {1 + 15 * i}, 15), 16, 10) as bigint) as sha{i}" for i in range(5)),
        "array(struct(1 as o, 1 as e, both as part), struct(1 as o, 0 as e, substring(text, length(both) + 1) as part), struct(0 as o, 1 as e, substring(edited, length(both) + 1) as part)) as parts",
    )
    keys = ["key", "next_id", "row", "n_chars", *(f"sha{i}" for i in range(5))]
    parts = rows.select(*keys, F.inline("parts")).select(*keys, "o", "e", F.explode(F.split("part", _SPLIT)).alias("word"))
    terms = parts.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), "o", "e")
    # the columns beside key and row only ride along
    ride = [F.max(c).alias(c) for c in keys if c not in ("key", "row")]
    counted = terms.groupBy("key", "row", "term").agg(F.sum("o").alias("o"), F.sum("e").alias("e"), *ride)
    # a term of equal weight in both texts is sampled once for both; without a word, a row of side 0 and no weight stays
    sides = F.expr("if(o = e or term is null, array(struct(0 as side, if(o > 0 and term is not null, o, null) as n)), filter(array(struct(1 as side, o as n), struct(2 as side, e as n)), x -> x.n > 0))")
    weighed = counted.select(*keys, "term", F.inline(sides)).withColumn("ln", F.log("n"))
    # samples go in parts that each compile: a row of a term for each part, under a hash of the term that is the part's own
    size = min(k, PART)
    parts = [F.struct(F.lit(j).alias("part"), (F.xxhash64("term", F.lit(-j)) if j else F.col("term")).alias("term")) for j in range(-(-k // size))]
    weighed = weighed.select(*keys, "side", F.when(F.col("term").isNotNull(), F.col("ln")).alias("ln"), F.inline(F.array(*parts)))
    mins = []
    for i in range(size):
        h1, h2 = F.xxhash64(F.col("term"), F.lit(2 * i)), F.xxhash64(F.col("term"), F.lit(2 * i + 1))
        r = -F.log(_uniform(h1, 32, 32) * _uniform(h1, 0, 32))
        c = F.log(-F.log(_uniform(h2, 0, 21) * _uniform(h2, 21, 21)))
        beta = _uniform(h2, 42, 22)
        mins.append(F.min(c - r * (F.floor(F.col("ln") / r + beta) - beta + 1)).alias(f"m{i}"))
    least = weighed.groupBy("key", "row", "part", "side").agg(*ride, *mins)
    both = [F.min(F.when(F.col("side") != other, F.col(f"m{i}"))).alias(f"{name}{i}") for other, name in ((2, "s"), (1, "e")) for i in range(size)]
    least = least.groupBy("key", "row", "part").agg(*ride, *both)
    short = lambda c: F.shiftright(F.xxhash64(F.coalesce(F.col(c), F.lit(0.0))), 48).cast("smallint")
    least = least.select(*keys, "part", *(F.array(*(short(f"{c}{i}") for i in range(size))).alias(c) for c in "se"))
    of = lambda c: F.slice(F.concat(*(F.max(F.when(F.col("part") == j, F.col(c))) for j in range(len(parts)))), 1, k).alias(c)
    least = least.groupBy("key", "row").agg(*ride, of("s"), of("e"))
    sha = F.concat(*(F.lpad(F.lower(F.conv(F.col(f"sha{i}").cast("string"), 10, 16)), 15 if i < 4 else 4, "0") for i in range(5)))
    return least.select("key", F.nullif("key", F.lit(_NO_ID)).alias("doc_id"), "next_id", "n_chars", sha.alias("edited_sha256"), "s", "e")


def likeness(a: str, b: str) -> Column:
    """Share of equal samples."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / cast(size({a}) as double)")


def shown(a: str) -> Column:
    """Samples as hexadecimal digits."""
    return F.expr(f"array_join(transform({a}, x -> lpad(lower(hex(cast(x as bigint) & 65535)), 4, '0')), '')")


def fingerprint(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    signed = save(samples(edited_texts(docs), k), "samples")
    # rows that share a doc_id: the next document's fingerprint is that of its first text, and so of the first samples in order of length and value
    other = signed.groupBy(F.col("key").alias("id")).agg(F.min("s").alias("s_next"))
    both = signed.join(other, F.expr("next_id = id"))
    return both.select("doc_id", "n_chars", "edited_sha256", shown("s").alias("fingerprint"), shown("e").alias("edited_fingerprint"), likeness("s", "e").alias("near_edited"), likeness("s", "s_next").alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint(table(spark, sf_dir, "documents"))
