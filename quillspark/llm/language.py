"""Language ID (operator 10) by cross-parsing entropy.

For each language, a suffix automaton of labelled text answers which strings occur in it.
A document is parsed against each: a phrase is the longest match from where the last one
ended, or one unknown letter.  Text of the automaton's own language needs few phrases, so
the language with the fewest phrases per letter wins (ties: the first by name).

A whole slice of documents is parsed in step, a letter of each at a time, in segments of 512
letters (every segment of every document; a segment's end ends a phrase, for each language
alike).  A letter or space that a language's sample lacks is a phrase of its own there.

Learning takes a bounded sample: about `SAMPLE_ROWS` rows for each language, chosen by a hash
of doc_id, of at most `SAMPLE_LONGEST` characters each, until `SAMPLE_LETTERS` letters
(`ALL_LETTERS` over all languages, for which twice as many letters and spaces are kept) are
there: an automaton holds one language's sample whole in each worker, so its size is bounded.
A language whose texts are all longer is learned from so many characters of them, from their
first letter on.  All documents are scored whole.

Edge cases: a null text, or one without a letter, is `und` with score 0; very long texts are
parsed whole, in segments; rows without a lang or letter teach nothing; if no row can teach,
every document is `und`; rows that share a doc_id, and repeated rows, are scored each; a null
doc_id is scored like any other; an empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ship, slices, table

SAMPLE_ROWS, SAMPLE_LONGEST, SAMPLE_LETTERS, ALL_LETTERS = 120, 20_000, 40_000, 400_000
SEGMENT = 512
SHARPNESS = 40.0  # how fast a language's share in the score falls with its phrases per letter


def _letter_table() -> np.ndarray:
    """Lower-case code point for each letter of the basic plane, 0 for any other character."""
    out = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


_TABLES: dict[str, np.ndarray] = {}


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the rows with one 0 between words, and the row offsets; a letter beyond the basic plane counts as U+FFFF."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = _letter_table()
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(starts, offsets)
    low = _TABLES["letters"][np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        each, at_each = np.unique(points[high], return_inverse=True)
        low[high] = np.array([0xFFFF if chr(c).isalpha() else 0 for c in each.tolist()], np.uint16)[at_each]
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    keep[inner] |= low[inner] != 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], upto[at]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring of the codes."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(to)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(to)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(dict(to[q]))
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to


class Parser:
    """A language's automaton as one array of transitions, in which the states' rows overlap.

    The transition of a state by a code lies at the state's base + code, with the state that
    owns the place beside it, so that memory grows with the transitions (at most three for
    each letter of the sample), whatever the number of letters in the script.
    """

    def __init__(self, codes: list[int], size: int):
        to = suffix_automaton(codes)
        self.base = np.full(len(to), size, np.int64)
        free = np.ones(4 * size + 2 * sum(map(len, to)), bool)
        free[:size] = False  # so that no base is less than 0
        begin, before, width = size, 0, 64
        for s in sorted(range(len(to)), key=lambda s: -len(to[s])):
            own = np.array(sorted(to[s]), np.int64)
            if not len(own):
                continue
            if len(own) != before:  # what is too full for many transitions has room for fewer
                begin, before = size, len(own)
            while True:
                if begin + width + size >= len(free):
                    free = np.append(free, np.ones(len(free), bool))
                at = np.arange(begin, begin + width)
                fits = free[at]
                fits[fits] = free[at[fits][:, None] + (own - own[0])].all(1)
                if fits.any():
                    begin += int(fits.argmax())
                    break
                begin += width
            self.base[s] = begin - own[0]
            free[self.base[s] + own] = False
        self.cells = np.full(int(self.base.max()) + size, np.int64(-1))  # owner << 32 | target; -1: no transition
        for s, own in enumerate(to):
            for c, t in own.items():
                self.cells[self.base[s] + c] = s << 32 | t
        self.start = np.zeros(size, np.int32)  # the state after a phrase's first letter
        for c, s in to[0].items():
            self.start[c] = s

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a letter each, and how many phrases ended: the open one before the letter, and the letter itself if it is unknown."""
        cell = self.cells[self.base[state] + codes]
        start = self.start[codes]
        missed = cell >> 32 != state
        ended = missed * ((state != 0).astype(np.int8) + (start == 0))
        return np.where(missed, start, cell & 0xFFFFFFFF).astype(np.int32), ended


class Languages:
    """Automata of the languages of a sample {language: text of lower-case letters and spaces}."""

    def __init__(self, sample: dict[str, str]):
        self.names = sorted(sample)
        known = sorted(set("".join(sample.values())) - {" "})
        self.code = np.full(0x10000, 0, np.int32)  # 0: a letter in no sample
        self.code[0] = 1
        for i, ch in enumerate(known):
            self.code[ord(ch)] = 2 + i
        self.parsers = [Parser([int(self.code[ord(c) if c != " " else 0]) for c in sample[name]], 2 + len(known)) for name in self.names]

    def phrases(self, low: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Phrases of each row (of letters() offsets) for each language."""
        lengths = np.diff(upto)
        parts = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(len(lengths)), parts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = upto[:-1][row] + number * SEGMENT
        most = np.minimum(lengths[row] - number * SEGMENT, SEGMENT)
        order = np.argsort(-most, kind="stable")
        row, first, most = row[order], first[order], most[order]
        codes = self.code[low]
        out = np.zeros((len(lengths), len(self.names)), np.int64)
        live = np.searchsorted(-most, -np.arange(SEGMENT), side="left")  # segments with more letters than so many
        steps = [codes[first[: live[j]] + j] for j in range(SEGMENT) if live[j]]
        for k, parser in enumerate(self.parsers):
            state = np.zeros(len(row), np.int32)
            ended = np.zeros(len(row), np.int64)
            for own in steps:
                n = len(own)
                state[:n], more = parser.step(state[:n], own)
                ended[:n] += more
            ended += state != 0
            np.add.at(out[:, k], row, ended)
        return out


def learn(docs: DataFrame, learnable: str) -> dict[str, str]:
    """Sample text of each language from the rows that the condition names."""
    rows = docs.where(f"({learnable}) and lang is not null and text rlike '\\\\p{{L}}'").withColumn("_short", F.expr(f"length(text) <= {SAMPLE_LONGEST}"))
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.count_if("_short"), F.count("*")).collect()}
    if not found:
        return {}
    counts = {lang: short or n for lang, (short, n) in found.items()}
    long_only = [lang for lang, (short, _) in found.items() if not short]
    start = F.expr(f"substring(regexp_replace(text, '^\\\\P{{L}}+', ''), 1, {SAMPLE_LONGEST})")
    rows = rows.where(F.col("_short") | F.col("lang").isin(long_only)).withColumn("text", F.when(F.col("_short"), F.col("text")).otherwise(start))
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_ROWS / n))).otherwise(chance)
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.withColumn("_order", order).where(F.col("_order") < chance).select("lang", "text", "_order", "doc_id").orderBy("_order", "doc_id", "text").limit(4 * SAMPLE_ROWS * len(counts))
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    size = dict.fromkeys(counts, 0)
    most = min(SAMPLE_LETTERS, ALL_LETTERS // len(counts))
    for r in sorted(picked.collect(), key=lambda r: (r["_order"], str(r["doc_id"]), r["text"])):
        if size[r["lang"]] < most:
            data = np.frombuffer(r["text"].encode(), np.uint8)
            low, _ = letters(data, np.array([0, len(data)]))
            texts[r["lang"]].append("".join(chr(c) if c else " " for c in low.tolist()))
            size[r["lang"]] += len(low)
    return {lang: " ".join(t)[: 2 * most] for lang, t in texts.items() if any(x.strip() for x in t)}


_LOADED: dict[str, Languages] = {}


def _loaded(sample: dict[str, str]) -> Languages:
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Languages(sample)
    return _LOADED[key]


def identify(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score of every document's whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _loaded(shared.value)
        names = np.array([*languages.names, "und"], dtype=object)
        for batch in batches:
            for part, data, offsets in slices(batch, "text", 1 << 20):
                low, upto = letters(data, offsets)
                some = np.concatenate([[0], np.cumsum(low != 0)])
                lettered = some[upto[1:]] > some[upto[:-1]]
                if not languages.names:
                    best, score = np.zeros(len(lettered), np.int64), np.zeros(len(lettered))
                    lettered[:] = False
                else:
                    each = languages.phrases(low, upto) / np.maximum(np.diff(upto), 1)[:, None]
                    best = each.argmin(1)
                    weight = np.exp(-SHARPNESS * (each - each.min(1, keepdims=True)))
                    score = 1 / weight.sum(1)
                best[~lettered], score[~lettered] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows with crc32(doc_id) mod 3 = 1 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    sample = learn(docs, f"not coalesce({held}, false)")
    return identify(docs, sample).select("doc_id", F.expr(f"coalesce({held}, false)").alias("held_out"), "lang_pred", "score")
