"""MinHash near-dedup (operator 4) with fast similarity sketching.

Sketch.  A document's set of word shingles is thrown into t bins in rounds: in round i < t
each element goes to one hashed bin with value (i, hash), and the least value stays; in
round t + j all elements go to bin j.  Rounds stop once every bin is filled, so a set of n
elements costs O(n + t log t) rather than O(n t), every coordinate is filled, and the share
of equal coordinates concentrates about the Jaccard similarity as independent samples do.

Banding.  With 32 bands of 5 coordinates, a pair at similarity 0.8 shares no band with
probability (1 - 0.8**5)**32 < 4e-6.

Verification.  Links are confirmed on the full sets, without all pairs of a bucket: equal
sets are one class from the start; each bucket that holds more than one component names a
pivot, and its other members are held against it.  Documents of buckets that still hold
several components are then dealt into buckets by their rarest shingles, of which similar
sets must share one, and in each round these name pivots.  Members that
link to a pivot are then in its component, so pairs within one component are never made.
The number of pivots grows 64-fold each round, and a pivot that has been held against its
bucket is spent, so every pair of a bucket is tested, already connected, or ruled out: the
shingles that a set shares with no other set bound its similarity to any.

A bucket may hold any share of all rows: its members are dealt to `SALTS` tasks where they
meet its pivots.

Edge cases: null or empty text has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle; very long texts are read whole, in time linear in their
length; of a component the least doc_id is kept; rows that share a doc_id share its
component; a null doc_id links with nothing and has a null component, and is kept; empty
tables give empty results; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import words
from quillspark.llm.common import copies, drop, likely, salts, save, ship, slices, spread, table

BANDS, ROWS = 32, 5
#: Sets with more rare shingles than this may be named with one partner in several buckets, which costs a test again and loses no link.
EARLIER_KEPT = 96

_ROUND_KEYS: dict[int, np.ndarray] = {}


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row, words lower-cased in A-Z."""
    starts, ends, first = words.spans(data, offsets)
    fp = words.fingerprints(data, starts, ends, lower=True)
    whole = words.windows(fp, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(words.windows(fp[a:b], b - a) ^ words.keys(1, 900 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set of 64-bit hashes (not empty)."""
    if t not in _ROUND_KEYS:
        _ROUND_KEYS[t] = words.keys(2 * t, 77)
    round_keys = _ROUND_KEYS[t]
    n, at = len(elements), 0
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, min(2 * t, max(4 * t // n + 1, 2)))
    while at < 2 * t:
        rounds = np.arange(at, min(at + step, 2 * t))
        h = words.mix(elements[None, :] ^ round_keys[rounds][:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        late = rounds >= t
        bins[late] = (rounds[late] - t)[:, None]
        values = rounds.astype(np.uint64)[:, None] << np.uint64(40) | h & np.uint64((1 << 40) - 1)
        np.minimum.at(best, bins.ravel(), values.ravel())
        at += step
        if int(best.max()) >> 40 < at:
            break
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a sketch."""
    return words.mix((words.mix(best).reshape(bands, rows) * words.keys(rows, 5)[None, :]).sum(1, dtype=np.uint64) + words.keys(bands, 6))


def _lists(values: list[np.ndarray]) -> pa.Array:
    lengths = np.array([0, *(len(v) for v in values)], np.int64).cumsum()
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(flat))


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit hash of the set) and band hashes of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                k1 = np.array([words.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([words.mix(s ^ words.P).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                keys = [band_keys(sketch(s, bands * rows), bands, rows) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), _lists(keys)], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and the full shingle set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(shingle_sets(data, offsets, size))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for undirected links (a, b), by alternating large and small stars.

    Each step is a join with the least neighbour of each node; no neighbour list is gathered.
    """
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = save(small.unionAll(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
        drop(large)
        drop(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one edge, to a centre."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return not twice.select("a").unionAll(inner.select("a")).take(1)


def _linked(pairs: DataFrame, sets: DataFrame, per: int, of: int) -> DataFrame:
    """Those pairs (a, b) whose sets' intersection is at least per/of of their union."""
    named = lambda side: likely(sets, pairs.select(F.col(side).alias("doc_id")), "doc_id").select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(of * F.col("shared") >= per * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b").distinct()


#: Whether two sets of n and m shingles, of which u and v are in no other set, could have the similarity.
_POSSIBLE = "coalesce(n + m is null or {of} * least(n - u, m - v) >= {per} * greatest(n + v, m + u), true)"
#: Whether two sets whose first common shingle has these places in them could: they share it and what follows, at most.
_REACH = "coalesce({of} * (1 + least(n - place, m - pplace)) >= {per} * (n + m - 1 - least(n - place, m - pplace)), true)"


def near_duplicates(docs: DataFrame, size: int = 5, per: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; links need similarity per/of on shingles of `size` words."""
    possible, reach = _POSSIBLE.format(per=per, of=of), _REACH.format(per=per, of=of)
    sketched = save(sketches(docs, size), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = save(full.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep", "k1", "k2"), "members")
    firsts = full.join(members.where("doc_id = rep").select("doc_id", "k1", "k2").distinct(), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    # rows that share a doc_id and a band give it twice, which only costs
    banded = save(firsts.select("doc_id", F.explode("bands").alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    hits = save(banded.join(shared, "band", "left_semi").select("band", "doc_id"), "hits")
    drop(banded)
    # no text moves; the few sets of other documents that pass make the bounds no tighter, and no bucket holds them
    texts = likely(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null"), hits, "doc_id")
    sets = save(full_sets(texts, size).where(F.size("shingles") > 0), "sets")
    # shingles that no other set has bound a set's similarity to every other: most that share a band by chance or by a passage end here
    alone = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last").groupBy("doc_id").agg(F.count("*").alias("u"))
    # a doc_id with several rows has no bounds (null)
    bound = sets.select("doc_id", F.size("shingles").alias("n")).groupBy("doc_id").agg(F.min("n").cast("bigint").alias("n"), F.count("*").alias("rows"))
    bound = bound.join(alone, "doc_id", "left").select("doc_id", F.when(F.col("rows") == 1, F.col("n")).alias("n"), F.coalesce("u", F.lit(0)).alias("u"))
    bound = save(bound.where(f"coalesce({of} * (n - u) >= {per} * n, true)"), "bound")

    # rows that share a doc_id but not the text lie in several classes, which they connect
    several = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    joined = save(members.join(several, "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct(), "joined")
    found: list[DataFrame] = [joined] if joined.take(1) else []
    tested: list[DataFrame] = []
    open_ = save(_unsettled(hits.join(bound, "doc_id").withColumn("comp", F.col("doc_id")).withColumn("earlier", F.lit(None).cast("array<bigint>")).withColumn("place", F.lit(None).cast("bigint"))), "open")
    drop(hits)
    comps, first, pivots = (components(joined) if found else None), True, 1
    while open_.take(1):
        # pivots are members with few shingles of their own, to which the others most likely link
        slot = F.pmod(F.xxhash64("doc_id", "band"), F.lit(pivots))
        rank = F.col("u") * (1 << 20) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        chosen = open_.groupBy("band", slot.alias("slot")).agg(F.min_by(F.struct("doc_id", "n", "u", "comp", "earlier", "place", "salts"), rank).alias("p"))
        chosen = save(chosen.selectExpr("band", "p.doc_id as pivot", "p.n as m", "p.u as v", "p.comp as pcomp", "p.earlier as pearlier", "p.place as pplace", "p.salts as salts"), "pivots")
        pairs = spread(open_, "doc_id").join(copies(chosen), ["band", "_salt"]).where(f"doc_id <> pivot and comp <> pcomp and {possible} and coalesce(not arrays_overlap(earlier, pearlier), true) and {reach}")
        pairs = pairs.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        left = open_.join(chosen.select("band", F.col("pivot").alias("doc_id")), ["band", "doc_id"], "left_anti").select("band", "doc_id", "n", "u", "comp", "earlier", "place")
        if pairs.take(1):
            tested.append(pairs)
            links = save(_linked(pairs, sets, per, of), "links")
            if links.take(1):
                found.append(links)
                comps = components(_union(found))
                left = left.drop("comp").join(comps, left.doc_id == comps.node, "left").select("band", "doc_id", "n", "u", F.coalesce("component", "doc_id").alias("comp"), "earlier", "place")
        left = _unsettled(left)
        if first:
            left = _unsettled(save(_prefixes(save(left, "bands-left"), sets, per, of), "prefixes"))
        new = save(left, "open")
        drop(open_)
        drop(chosen)
        open_, first, pivots = new, False, 1 if first else pivots * 64
    drop(sets)
    out = members.select("doc_id", "n_shingles", "rep")
    if comps is None:
        out = out.withColumn("component_id", F.col("rep"))
    else:
        out = out.join(comps, out.rep == comps.node, "left").withColumn("component_id", F.coalesce("component", "rep"))
    rest = sketched.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionAll(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _prefixes(rows: DataFrame, sets: DataFrame, per: int, of: int) -> DataFrame:
    """The same documents dealt into buckets of another kind: the rarest shingles of each set, as many as any set of the similarity must meet.

    Two such sets share a shingle among the n - ceil(n * per / of) + 1 rarest of each, in one order for all.
    """
    live = rows.select("doc_id", "n", "u", "comp").distinct()
    each = likely(sets, rows, "doc_id").select("doc_id", F.explode("shingles").alias("band"))
    common = each.groupBy("band").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common, "band").join(live, "doc_id")  # shingles move, not sets; only here do sets of other documents end
    alone = F.col("n") - F.count("*").over(W.partitionBy("doc_id"))  # these come first in a set's order
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "band")) + alone
    most = F.col("n") - F.ceil(F.col("n") * per / of) + 1
    kept = shared.select("band", "doc_id", "n", "u", "comp", place.alias("place"), most.alias("most")).where("coalesce(place <= most, true)")
    # the rarer shingles of the same set, by which a pair is named in the first bucket that it shares and in no other; long sets go without
    before = F.collect_list(F.when(F.col("most") <= EARLIER_KEPT, F.col("band"))).over(W.partitionBy("doc_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return kept.select("band", "doc_id", "n", "u", "comp", F.when(F.col("most") <= EARLIER_KEPT, before).alias("earlier"), F.when(F.col("n").isNotNull(), F.col("place").cast("bigint")).alias("place"))


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows of bands with more than one component, and `salts` of their band."""
    rows = spread(rows, "doc_id")
    mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), salts().alias("salts")).where("lo <> hi").select("band", "salts")
    met = mixed.withColumn("of_band", F.col("salts"))
    return rows.join(copies(met), ["band", "_salt"]).drop("_salt").withColumnRenamed("of_band", "salts")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
