"""Substring dedup (operator 6) by recompression.

Recompression.  A text is a string of word fingerprints.  In each round, maximal runs of
equal neighbours become one symbol (symbol, length), and then pairs of neighbours, the first
from the left and the second from the right half of the alphabet (halves by a hash of name
and round), become one symbol.  A name is a fingerprint of what it stands for, so that all
executors give equal substrings one name: the global naming needs no shuffle.  Rounds go on
until symbols outgrow the window.

Each symbol keeps its context: the words that decide that just this symbol is at this place.
A pair adds nothing to the contexts of its parts; a symbol left single in a round adds the
one neighbour that could have joined it; a run adds as many words on either side as tell that
it ends there.  Wherever the words of a context recur, so does the symbol.

Reveal.  The longest symbol whose context lies in a window of 35 words (of equally long ones
the one of greatest hash) is the window's name, so that equal windows have the same one.
Names that more than one text has, which Spark counts, reveal where long repeats may be.
A window without such a symbol (one in a long run, say) is its own name.

Verify.  Only the windows whose name is shared are expanded and compared, by 96-bit hashes of
their words; each text gives each different window once, and equal texts are one text with a
number of copies.  Repeats within a text are found in the text itself.

A word is removed if a window that covers it starts anywhere else too.

Edge cases: null text has no words; texts with fewer words than a window stay whole; very
long texts are read whole, in time linear in their length; rows that share a doc_id, and rows
without one, are separate documents, told apart by their texts; equal rows are copies of each
other, so all their words go; empty tables give empty results; extra columns are not looked
at, and with `keep_row` come out as fields of `_row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words
from quillspark.llm.common import drop, having_key, save, ship, slices, table, with_row

ROUNDS = 16  # at most; symbols outgrow the window before
_FAR = np.int64(1 << 60)


class _Symbols:
    """Symbols of a slice of texts: names, first word and word after the last, and the same of their contexts."""

    def __init__(self, name: np.ndarray, a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray):
        self.name, self.a, self.b, self.ca, self.cb = name, a, b, ca, cb


def _runs(s: _Symbols, fp: np.ndarray, row: np.ndarray) -> tuple[_Symbols, np.ndarray]:
    """Maximal runs as one symbol each; which symbols are runs."""
    n = len(s.name)
    own = row[s.a]
    edge = np.append(True, (s.name[1:] != s.name[:-1]) | (own[1:] != own[:-1]))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    times = last - first + 1
    name = s.name[first]
    run = times > 1
    name = np.where(run, words.mix(name * words.keys(1, 40) + times.astype(np.uint64)), name)
    ca, cb = np.minimum.reduceat(s.ca, first), np.maximum.reduceat(s.cb, first)
    a, b = s.a[first], s.b[last]
    # where a run ends is told by the next word, if it differs from the run's own first or last one, else by the whole neighbour
    left = np.maximum(first - 1, 0)
    some = (first > 0) & (own[left] == own[first])
    told = np.where(fp[np.maximum(a - 1, 0)] != fp[b - 1], a - 1, s.ca[left])
    ca = np.where(some, np.minimum(ca, told), -_FAR)
    right = np.minimum(last + 1, n - 1)
    some = (last + 1 < n) & (own[right] == own[last])
    told = np.where(fp[np.minimum(b, len(fp) - 1)] != fp[a], b + 1, s.cb[right])
    cb = np.where(some, np.maximum(cb, told), _FAR)
    return _Symbols(name, a, b, ca, cb), run


def _pairs(s: _Symbols, row: np.ndarray, level: int) -> tuple[_Symbols, np.ndarray]:
    """Pairs of the left and the right half as one symbol each; which symbols are pairs."""
    own = row[s.a]
    side = words.mix(s.name + words.keys(1, 60 + level)) & np.uint64(1)
    near = own[1:] == own[:-1]
    first = np.append((side[:-1] == 0) & (side[1:] == 1) & near, False)
    second = np.append(False, first[:-1])
    after = np.append(s.name[1:], np.uint64(0))
    name = np.where(first, words.mix(s.name * words.keys(1, 80) + words.mix(after)), s.name)
    # a single of the left half could have had its right neighbour, one of the right half its left neighbour
    has_right, has_left = np.append(near, False), np.append(False, near)
    next_cb, last_ca = np.append(s.cb[1:], _FAR), np.append(-_FAR, s.ca[:-1])
    cb = np.where(side == 0, np.where(has_right, np.maximum(s.cb, next_cb), _FAR), s.cb)
    ca = np.where((side == 1), np.where(has_left, np.minimum(s.ca, last_ca), -_FAR), s.ca)
    ca = np.where(first, np.minimum(s.ca, np.append(s.ca[1:], _FAR)), ca)
    cb = np.where(first, np.maximum(s.cb, np.append(s.cb[1:], -_FAR)), cb)
    b = np.where(first, np.append(s.b[1:], 0), s.b)
    keep = ~second
    return _Symbols(name[keep], s.a[keep], b[keep], ca[keep], cb[keep]), first[keep]


def recompress(fp: np.ndarray, row: np.ndarray, longest: int) -> list[_Symbols]:
    """All symbols whose context has at most `longest` words, as they arise in the rounds; symbols don't cross rows."""
    at = np.arange(len(fp), dtype=np.int64)
    s = _Symbols(fp, at, at + 1, at, at + 1)
    out = []
    for level in range(ROUNDS):
        if len(s.name) < 2:
            break
        live = False
        for step in ((lambda s: _runs(s, fp, row)), (lambda s, k=level: _pairs(s, row, k))):
            s, new = step(s)
            short = s.cb - s.ca <= longest
            live |= bool(short.any())
            new &= short
            if new.any():
                out.append(_Symbols(s.name[new], s.a[new], s.b[new], s.ca[new], s.cb[new]))
        if not live:
            break
    return out


def window_names(fp: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows, and for each the name of its longest symbol (0: it has none)."""
    starts = words.inside(first, window)
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n, bits = len(fp), window.bit_length()
    depth = bits  # best[k, i]: of the symbols for the windows that start at i to i + 2**k - 1
    best = np.zeros((depth, n), np.uint64)
    for s in recompress(fp, row, window):
        own = row[s.a]
        lo, hi = np.maximum(s.cb - window, first[own]), np.minimum(s.ca, first[own + 1] - window)
        ok = lo <= hi
        lo, hi, name, span = lo[ok], hi[ok], s.name[ok], (s.b - s.a)[ok]
        weight = span.astype(np.uint64) << np.uint64(64 - bits) | words.mix(name) >> np.uint64(bits)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
        np.maximum.at(best, (k, lo), weight)
        np.maximum.at(best, (k, hi - (1 << k) + 1), weight)
    for k in range(depth - 1, 0, -1):
        half = 1 << k - 1
        np.maximum(best[k - 1], best[k], out=best[k - 1])
        np.maximum(best[k - 1, half:], best[k, :-half], out=best[k - 1, half:])
    return starts, best[0][starts]


class _Windows:
    """The windows of a slice of texts: starts, names, hashes; by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, names: bool = True):
        self.word_starts, self.word_ends, self.first = words.spans(data, offsets)
        fp = words.fingerprints(data, self.word_starts, self.word_ends)
        self.n_words = np.diff(self.first)
        self.fp = fp
        self.starts = words.inside(self.first, window)
        self.h1 = words.windows(fp, window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        if names:
            named = window_names(fp, self.first, window)[1]
            self.keys = np.where(named > 0, named, self.h1)
        counts = np.maximum(self.n_words - window + 1, 0)
        self.upto = np.concatenate([[0], np.cumsum(counts)])

    def text_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash of each row's sequence of words."""
        sums = np.zeros((2, len(self.fp) + 1), np.uint64)
        local = (np.arange(len(self.fp)) - np.repeat(self.first[:-1], self.n_words)).astype(np.uint64)
        for k in (0, 1):
            np.cumsum(words.mix(self.fp + words.mix(local + words.keys(1, 20 + k))), out=sums[k, 1:])
        return tuple((s[self.first[1:]] - s[self.first[:-1]]).view(np.int64) for s in sums)


def _second(data: np.ndarray, own: _Windows, window: int) -> np.ndarray:
    """A further 32 bits of each window's hash, from other word fingerprints."""
    other = words.fingerprints(data, own.word_starts, own.word_ends, seed=2)
    return (words.windows(other, window)[own.starts] >> np.uint64(33)).astype(np.int32)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    lengths = np.array([0, *(len(v) for v in values)], np.int64).cumsum().astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _outline(texts: DataFrame, window: int) -> DataFrame:
    """rid, t, k1 and k2 (hash of the word sequence), keys (distinct names of windows) and own (a window recurs within) of the texts that have a window.  texts: rid, t, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                w = _Windows(data, offsets, window)
                rows = np.flatnonzero(np.diff(w.upto) > 0)
                k1, k2 = w.text_keys()
                spans = [(int(w.upto[i]), int(w.upto[i + 1])) for i in rows]
                keys = [np.unique(w.keys[a:b]) for a, b in spans]
                own = [b - a > 1 and len(np.unique(w.h1[a:b])) < b - a for a, b in spans]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("rid", "t")), pa.array(k1[rows]), pa.array(k2[rows]), _lists(keys, pa.int64()), pa.array(own, pa.bool_())], ["rid", "t", "k1", "k2", "keys", "own"])

    return texts.mapInArrow(run, "rid bigint, t bigint, k1 bigint, k2 bigint, keys array<bigint>, own boolean")


def _candidates(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2, and the distinct windows with a shared name: starts, h1, h2.  texts: k1, k2, text, shared (names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                w = _Windows(data, offsets, window)
                h2 = _second(data, w, window)
                at: list[np.ndarray] = []
                k1, k2 = w.text_keys()
                right = np.flatnonzero((k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy()))
                shared = part.column("shared")
                for i in right.tolist():
                    a, b = w.upto[i], w.upto[i + 1]
                    hit = np.isin(w.keys[a:b], shared[i].values.to_numpy().view(np.uint64))
                    picked = np.flatnonzero(hit) + a
                    at.append(picked[np.unique(w.h1[picked], return_index=True)[1]])
                rows = pa.array(right, pa.int64())
                firsts = [(w.starts[x] - w.first[i]).astype(np.int32) for i, x in zip(right.tolist(), at, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("k1").take(rows), part.column("k2").take(rows), _lists(firsts, pa.int32()), _lists([w.h1[x] for x in at], pa.int64()), _lists([h2[x] for x in at], pa.int32())], ["k1", "k2", "starts", "h1", "h2"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, starts array<int>, h1 array<bigint>, h2 array<int>")


_SPANS = "array<struct<first:int,last:int>>"


def _removal(texts: DataFrame, window: int) -> DataFrame:
    """_row, n_words, n_removed, kept_text, removed (spans of words).  texts: _row, k1, k2, whole, starts (the verdict on the text, or null)."""
    schema = T.StructType([texts.schema["_row"], *T.StructType.fromDDL(f"n_words bigint, n_removed bigint, kept_text string, removed {_SPANS}").fields])
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                v1, v2, whole, starts = (part.column(c).to_pylist() for c in ("k1", "k2", "whole", "starts"))
                texts = part.column("text").to_pylist()
                n_words, n_removed, kept, spans = [], [], [], []
                w = _Windows(data, offsets, window, names=False) if any(x is not None for x in v1) else None
                k1, k2 = w.text_keys() if w else ((), ())
                for i, text in enumerate(texts):
                    own = (text or "").encode().split()
                    gone = _gone(w, i, window, whole[i], starts[i] or []) if v1[i] is not None and v1[i] == k1[i] and v2[i] == k2[i] else None
                    n_words.append(len(own))
                    if gone is None or not gone.any():
                        n_removed.append(0)
                        spans.append([])
                    else:
                        own = [x for x, g in zip(own, gone.tolist(), strict=True) if not g]
                        n_removed.append(int(gone.sum()))
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                        spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)], schema.names)

    return texts.mapInArrow(run, schema)


def _gone(w: _Windows, i: int, window: int, whole: bool, starts: list[int]) -> np.ndarray:
    """Which words of row i go."""
    n = int(w.n_words[i])
    if n < window:
        return np.zeros(n, bool)
    if whole:
        return np.ones(n, bool)
    h1 = w.h1[w.upto[i] : w.upto[i + 1]]
    _, inverse, counts = np.unique(h1, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    shared = np.zeros(len(counts), bool)
    shared[inverse[np.asarray(starts, np.int64)]] = True
    return words.cover(n, np.flatnonzero(repeated | shared[inverse]), window)


def remove_repeats(docs: DataFrame, window: int = 35, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (spans of words) of every document; with `keep_row` also `_row`, its columns as they came."""
    ship(docs.sparkSession)
    # a row's own id for joins: its doc_id, or a hash of its text; with a hash of the text it names texts that share an id
    own = [F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text", F.lit(1))).alias("rid"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text")]
    texts = docs.select(*own)
    outline = save(_outline(texts, window), "outline")
    best = F.min(F.struct("rid", "t"))
    classes = save(outline.groupBy("k1", "k2").agg(best.alias("rep"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"), F.any_value("own").alias("own")).select("k1", "k2", "rep.*", "copies", "keys", "own"), "classes")
    keyed = classes.select("k1", "k2", "rid", "t", F.explode("keys").alias("key"))
    shared = save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hits = having_key(keyed, shared, ["key"], total).groupBy("k1", "k2", "rid", "t").agg(F.collect_list("key").alias("shared"))
    hits = save(hits, "hits")
    candidates = save(_candidates(texts.join(hits, ["rid", "t"]).select("k1", "k2", "text", "shared"), window), "candidates")
    drop(shared)
    drop(hits)
    each = candidates.select("k1", "k2", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("w")).select("k1", "k2", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), F.col("w.starts").alias("start"))
    # rows that share doc_id and text have given the same windows more than once: a class counts once
    twice = each.groupBy("h1", "h2").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2"), F.count("*").alias("n")).where("lo <> hi or lo2 <> hi2").select("h1", "h2", "n")
    twice = save(twice, "twice")
    total = twice.agg(F.sum("n")).first()[0] or 0
    repeats = having_key(each, twice, ["h1", "h2"], total).groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))
    repeats = save(repeats, "repeats")
    drop(candidates)
    drop(twice)
    marks = classes.join(repeats, ["k1", "k2"], "left").where("copies > 1 or own or starts is not null")
    marks = marks.select("k1", "k2", (F.col("copies") > 1).alias("whole"), F.when(F.col("copies") == 1, F.col("starts")).alias("starts"))
    verdicts = save(outline.select("rid", "t", "k1", "k2").join(marks, ["k1", "k2"]).dropDuplicates(["rid", "t"]), "verdicts")
    for done in (outline, classes, repeats):
        drop(done)
    out = _removal(with_row(docs, *own[:2]).join(verdicts, ["rid", "t"], "left").select("_row", "k1", "k2", "whole", "starts"), window)
    shown = ["n_words", "n_removed", "kept_text", "removed", *(["_row"] if keep_row else [])]
    return out.select(F.col("_row.doc_id").cast("bigint").alias("doc_id"), *shown)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left once all windows of 35 words that recur are removed."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
