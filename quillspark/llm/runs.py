"""Periodic runs of words (operator 13): internal pattern matching.

A run is a stretch of words with smallest period q, of at least four periods and six words,
that no neighbouring word extends.  Take the least power of two L >= q.  Every block of L words
that starts at a multiple of L and lies in the run occurs again, nearest at distance q, after
it or before it: the run has room on one side since 2q + L <= 4q, and a nearer occurrence would
make the repeated word a power.  So for each such block one asks for its next and its previous
occurrence within the window of L words on either side; where the distance is over L/2, it is
the difference of the progression of occurrences there and a candidate for the period.

Occurrences of a block are a range of the suffix array, and the next one after a place is a
range successor: the wavelet matrix over the suffix array answers it in one descent for the
rank and one for the value.  Candidates are extended by up to L words on either side, those
of a period that meet are joined, and powers of shorter periods go.  Since each block of a run
gives its candidate, joined stretches of four periods are whole.  Periods of up to four
words are compared directly at all places.

Many texts are worked on together in batches of numpy columns: a word's number holds its text's,
so that nothing matches across texts.  The suffix array is built by prefix doubling over the
places whose blocks still recur in their text, which after eight words are few in prose.

Edge cases: a null or empty text has no words; a null doc_id gives no periodic copy of its
text; texts of any length are taken whole; equal rows are rows each; an empty table gives an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import ship, slices, table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods up to this are compared at all places; blocks begin at twice this many words.
DIRECT = 4


class Wavelet:
    """A wavelet matrix over numbers below 2 ** bits: how many in a range are less, and the k-th of a range."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones = np.zeros((self.bits, len(values) + 1), np.int64)  # before each place, by level
        for level in range(self.bits):
            bit = values >> (self.bits - 1 - level) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _down(self, level: int, at: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Where a place goes on the next level, by the bit taken."""
        before = self.ones[level, at]
        return np.where(ones, self.ones.shape[1] - 1 - self.ones[level, -1] + before, at - before)

    def less(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        count, all_of_them = np.zeros(len(lo), np.int64), hi - lo
        for level in range(self.bits):
            bit = (than >> (self.bits - 1 - level) & 1).astype(bool)
            zeros = (hi - lo) - (self.ones[level, hi] - self.ones[level, lo])
            count += np.where(bit, zeros, 0)
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return np.where(than >> self.bits > 0, all_of_them, count)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            zeros = (hi - lo) - (self.ones[level, hi] - self.ones[level, lo])
            bit = k >= zeros
            k = np.where(bit, k - zeros, k)
            value = value << 1 | bit
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return value


def _name(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0, equal for equal keys, in the order of keys."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def _pairs(names: np.ndarray, gap: int) -> np.ndarray:
    """Names of twice as many words; the places of blocks that occur once are named apart without being sorted."""
    n = len(names)
    after = np.full(n, -1, np.int64)
    after[: max(0, n - gap)] = names[gap:]
    often = np.bincount(names, minlength=1)[names] > 1
    out = np.empty(n, np.int64)
    out[often] = _name((names[often] << 32) + after[often] + 1)
    out[~often] = np.arange(int(often.sum()), n)
    return out


def _suffixes(names: np.ndarray, block: int, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of the places whose blocks recur, and for each block length its aligned recurring blocks: (length, places, first and end of their range)."""
    n = len(names)
    counts = np.bincount(names, minlength=1)
    array = np.flatnonzero(counts[names] > 1)
    array = array[np.argsort(names[array], kind="stable")]
    name = n + np.arange(2 * n)  # what is not in the array is named by its place; after the end as well
    slots, levels = np.arange(len(array)), []
    keys = names[array]
    while True:
        if len(slots):
            new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            size = np.diff(new, append=len(keys))
            first = np.repeat(slots[new], size)
            many = np.repeat(size > 1, size)
            name[array[slots]] = first
            end = np.repeat(slots[new] + size, size)
            slots, first, end = slots[many], first[many], end[many]
        if not len(slots) or block > 2 * longest:
            return array, levels
        places = array[slots]
        aligned = places % block == 0
        levels.append((block, places[aligned], first[aligned], end[aligned]))
        keys = (first << 32) + name[np.minimum(places + block, 2 * n - 1)]
        order = np.argsort(keys, kind="stable")
        array[slots], keys = places[order], keys[order]
        block *= 2


def _candidates(names: np.ndarray, block: int, longest: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(starts of stretches of L words that are repeated at a distance, the distances, L)."""
    array, levels = _suffixes(names, block, longest)
    if not levels:
        return []
    tree, out = Wavelet(array), []
    for length, places, lo, hi in levels:
        rank = tree.less(lo, hi, places)  # of the block itself in its range
        for step in (1, -1):
            k = rank + step
            has = (k >= 0) & (k < hi - lo)
            other = tree.kth(lo[has], hi[has], k[has])
            at = places[has]
            distance = np.abs(other - at)
            near = (distance <= length) & (distance > length // 2)
            out.append((np.minimum(at, other)[near], distance[near], length))
    return out


def _extend(words: np.ndarray, starts: np.ndarray, distances: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around each, extended by up to `length` on either side, in which words a distance apart are equal."""
    n, step = len(words), max(1, (1 << 22) // length)
    lows, highs = [], []
    for lo in range(0, len(starts), step):
        at, apart = starts[lo : lo + step, None], distances[lo : lo + step, None]

        def reach(places: np.ndarray) -> np.ndarray:
            inside = (places >= 0) & (places + apart < n)  # noqa: B023
            places = np.where(inside, places, 0)
            same = inside & (words[places] == words[np.minimum(places + apart, n - 1)])  # noqa: B023
            return np.where(same.all(axis=1), length, (~same).argmax(axis=1))

        lows.append(at[:, 0] - reach(at - 1 - np.arange(length)))
        highs.append(at[:, 0] + length + reach(at + length + np.arange(length)))
    return np.concatenate(lows), np.concatenate(highs)


def _joined(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a period that meet, as one."""
    order = np.lexsort((starts, periods))
    starts, ends, periods = starts[order], ends[order], periods[order]
    if not len(starts):
        return starts, ends, periods
    # stretches of a period come in their order; each period's places are moved past those of the one before
    shift = np.cumsum(np.diff(periods, prepend=periods[0]) != 0) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift)
    new = np.concatenate([[True], starts[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.maximum.reduceat(ends, at), periods[at]


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _primitive(words: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which stretches have no shorter period: it would divide theirs."""
    keep = np.ones(len(starts), bool)
    for q in np.unique(periods[periods > 1]).tolist():
        own = np.flatnonzero(periods == q)
        for lo in range(0, len(own), max(1, (1 << 22) // q)):
            some = own[lo : lo + max(1, (1 << 22) // q)]
            one = words[starts[some][:, None] + np.arange(q)]
            for p in _primes(q):
                keep[some] &= (one != np.roll(one, q // p, axis=1)).any(axis=1)
    return keep


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and period; words of different texts (from first[k] to first[k + 1]) are different numbers."""
    n = len(words)
    longest = int(np.diff(first).max(initial=0)) // LEAST_PERIODS  # of all periods
    starts, ends, periods = [], [], []
    for q in range(1, min(DIRECT, longest) + 1):
        same = np.zeros(n + 1 - q, bool)
        same[:-1] = words[q:] == words[:-q]
        edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0))
        starts.append(edge[::2])
        ends.append(edge[1::2])
        periods.append(np.full(len(edge) // 2, q))
    if longest > DIRECT:
        names, block = words, 1
        while block < 2 * DIRECT:
            names, block = _pairs(names, block), 2 * block
        for at, apart, length in _candidates(names, block, longest):
            if len(at):
                lo, hi = _extend(words, at, apart, length)
                starts.append(lo)
                ends.append(hi)
                periods.append(apart)
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = _joined(*(np.concatenate(x).astype(np.int64) for x in (starts, ends, periods)))
    end = end + period
    enough = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[enough], end[enough], period[enough]
    keep = _primitive(words, start, period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of a text, for a tenth of all documents made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_OUT = "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
_TYPES = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    else:
        kept = words
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    start, length, period = best or (None,) * 3
    return {
        "doc_id": doc_id, "n_words": len(words), "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
    }


def _mapper(planted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                ids, raw = part.column("doc_id").to_pylist(), data.tobytes()
                texts = [raw[lo:hi].split() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]  # bytes split at the six blanks of the contract
                if planted:
                    texts = [_planted(i, w) if i is not None else w for i, w in zip(ids, texts, strict=True)]
                first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
                number = defaultdict(count().__next__)
                flat = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(first[-1]))
                words = _name((np.repeat(np.arange(len(texts)), np.diff(first)) << 32) + flat)
                start, end, period = find_runs(words, first)
                row = np.searchsorted(first, start, side="right") - 1
                of = np.searchsorted(row, np.arange(len(texts) + 1))
                found = np.stack([start - first[row], end - start, period], axis=1).tolist()
                yield pa.RecordBatch.from_pylist([_row(i, w, [tuple(x) for x in found[of[k] : of[k + 1]]]) for k, (i, w) in enumerate(zip(ids, texts, strict=True))], schema=_TYPES)

    return run


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per document of doc_id and text: how many runs, the one of greatest exponent, digests of all runs and of the text that keeps one period of each, and the runs.

    With `planted`, a tenth of the texts are first made periodic from some word on, by a rule of their doc_id.
    """
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_mapper(planted), _OUT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them made periodic."""
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True).drop("runs")
