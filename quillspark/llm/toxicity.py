"""Toxicity (operator 8) by compression distance.

Two zstandard dictionaries are made apart: one of ordinary text, one of the passages of toxic
text that set it apart.  A window of a text is compressed with either; the share of its bytes
that the toxic one saves against the ordinary one, in hundredths of what there is to save, is
the window's distance.  A document's distance is its largest window's, and a monotone
calibration on labelled rows that made no dictionary turns it into a score.

Toxic documents are ordinary text but for a few words, so that a dictionary of all their text
is one of ordinary text.  The passages are the words whose first letters, or which whole,
stand in more toxic documents than chance can explain (a likelihood ratio against the number
of things looked at) and 20 times as often as in ordinary ones.  The toxic dictionary is the
content of all of them, and the ordinary one that of the words of ordinary texts up to
ORDINARY_BYTES; the most frequent stand last, where matches cost least.  A window is one word
with the spaces around it, lower case, letters only; so that a match weighs more than the
fixed costs of a short frame, every byte is spelled as three fixed pseudo-random bytes before
it is compressed or put in a dictionary.  What there is to save is what the ordinary dictionary takes beyond the
least that any passage takes with the toxic one.  Words recur, so workers keep a bounded table
of windows already measured; that changes no result.

Learning takes bounded samples: about `TOXIC_ROWS` and `ORDINARY_ROWS` labelled rows, chosen
by a hash of doc_id and read whole.  Every document is scored whole.

Edge cases: null and empty texts, and texts without a letter, have distance 0 and its
calibrated score; very long texts are scored whole, in time linear in their length; windows of
equal distance count alike; without toxic or ordinary rows to learn from, every score is 0;
rows that share a doc_id are scored each by their own text; repeated rows are scored each; a
null doc_id is scored but teaches nothing; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import words
from quillspark.llm.common import ship, table

TOXIC_ROWS, ORDINARY_ROWS = 1200, 4000
ORDINARY_BYTES = 200_000  # of the ordinary dictionary; the toxic one holds every passage
WINDOWS_KEPT = 500_000
_NO_LETTER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_SPELLED = [words.keys(256, 8)[i].tobytes()[3:6] for i in range(256)]
_PARAMETERS = {"window_log": 22, "chain_log": 20, "hash_log": 20, "search_log": 6, "min_match": 6, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}


def spell(text: bytes) -> bytes:
    """Three bytes for each byte."""
    return b"".join([_SPELLED[c] for c in text])


def windows(text: str | None) -> list[bytes]:
    """The words of a text, lower case, letters only."""
    return _NO_LETTER.sub(b" ", (text or "").lower().encode()).split()


def _marks(word: bytes) -> list[bytes]:
    """What a word shares with others: its first letters, or all of it."""
    return [b" " + word[:k] for k in (4, 5, 6, 8) if len(word) > k] + ([b" " + word + b" "] if len(word) >= 4 else [])


def _apart(k: int, n: int, share: float, tried: int) -> bool:
    """Whether k toxic documents among the n that have a mark are more than chance: share of toxic ones among all, number of marks."""
    r = k / n
    if k < 3 or r <= share:
        return False
    gain = k * math.log(r / share) + (n - k) * math.log((1 - r) / (1 - share) if k < n else 1.0)
    return gain > math.log(100 * tried)


def passages(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words of toxic texts that set them apart, as often as they occur."""
    in_toxic: Counter[bytes] = Counter()
    in_ordinary: Counter[bytes] = Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            counts.update({m for w in set(windows(t)) for m in _marks(w)})
    share = len(toxic) / (len(toxic) + len(ordinary))
    apart = {m for m, k in in_toxic.items() if _apart(k, k + in_ordinary[m], share, len(in_toxic)) and k / len(toxic) > 20 * (in_ordinary[m] + 0.5) / len(ordinary)}
    return [b" " + w + b" " for t in toxic for w in windows(t) if any(m in apart for m in _marks(w))]


def _content(counts: Counter[bytes], most: int | None = None) -> bytes:
    """Windows as the content of a dictionary, the most frequent last; at most so many bytes of them."""
    out = b"".join(spell(w) for w, _ in sorted(counts.items(), key=lambda x: (x[1], x[0])))
    return out if most is None else out[-most:]


class Model:
    """Both dictionaries, the least that a passage takes with its own, and the calibration."""

    def __init__(self, ordinary: bytes, toxic: bytes, least: int, scores: np.ndarray):
        self.ordinary, self.toxic, self.least, self.scores = ordinary, toxic, least, scores

    @staticmethod
    def fit(rows: list[tuple[str, int]]) -> Model | None:
        """From (text, label) rows: two of three of either label make the dictionaries, the third calibrates."""
        kinds = [[r for r in rows if bool(r[1]) == kind] for kind in (True, False)]
        train, held = [r for own in kinds for i, r in enumerate(own) if i % 3 != 2], [r for own in kinds for r in own[2::3]]
        toxic, ordinary = list(dict.fromkeys(t for t, y in train if y)), list(dict.fromkeys(t for t, y in train if not y))
        if not toxic or not ordinary:
            return None
        apart = Counter(passages(toxic, ordinary) or [b" " + w + b" " for t in toxic for w in windows(t)])
        plain = Counter(b" " + w + b" " for t in ordinary for w in set(windows(t)))
        model = Model(_content(plain, ORDINARY_BYTES), _content(apart), 0, np.zeros(0))
        with_toxic = _compressor(model.toxic)
        model.least = min((len(with_toxic.compress(spell(w))) for w in apart), default=0)
        measure = Measure(model)
        model.scores = _calibrated([(measure.text(t), y) for t, y in held or train])
        return model


def _calibrated(rows: list[tuple[int, int]]) -> np.ndarray:
    """Score by distance: rates that never fall, by pooling neighbours that do, with half a row of either label added to each pool, and straight lines between the distances seen."""
    seen = sorted({d for d, _ in rows})
    pools: list[list[float]] = []
    for d in seen:
        y = [label for distance, label in rows if distance == d]
        pools.append([float(sum(y)), float(len(y)), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    if not seen:
        return np.zeros(1)
    return np.interp(np.arange(seen[-1] + 1), seen, np.concatenate([np.full(int(k), (y + 0.5) / (n + 1)) for y, n, k in pools]))


class Measure:
    """Distances of windows and texts."""

    def __init__(self, model: Model):
        self.ordinary = _compressor(model.ordinary)
        self.toxic = _compressor(model.toxic)
        self.least, self.scores = model.least, model.scores
        self.kept: dict[bytes, int] = {}

    def window(self, word: bytes) -> int:
        """Hundredths of what there is to save on a word that the toxic dictionary saves."""
        got = self.kept.get(word)
        if got is None:
            spelled = spell(b" " + word + b" ")
            plain = len(self.ordinary.compress(spelled))
            got = max(0, min(100, round(100 * (plain - len(self.toxic.compress(spelled))) / max(1, plain - self.least))))
            if len(self.kept) >= WINDOWS_KEPT:
                self.kept.clear()
            if len(word) < 64:
                self.kept[word] = got
        return got

    def text(self, text: str | None) -> int:
        """The largest distance of a text's windows."""
        return max(map(self.window, windows(text)), default=0)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False, write_dict_id=False, write_checksum=False)
    dictionary = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=dictionary)


_LOADED: dict[tuple, Measure] = {}


def _loaded(ordinary: bytes, toxic: bytes, least: int, scores: np.ndarray) -> Measure:
    key = (ordinary, toxic, least, scores.tobytes())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Measure(Model(ordinary, toxic, least, scores))
    return _LOADED[key]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], learnable: str) -> DataFrame:
    """text and label of a bounded sample of the labelled rows that the condition on doc_id allows: about `rows` of each label, by a hash of doc_id."""
    own = labels.where(f"doc_id is not null and {label} is not null and ({learnable})").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).alias("label"))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    chance = F.lit(0.0)
    for y, most in rows.items():
        chance = F.when(F.col("label") == y, F.lit(min(1.0, most / max(1, counts.get(y, 1))))).otherwise(chance)
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 40)) / float(1 << 40)
    picked = own.withColumn("_order", order).where(F.col("_order") < chance)
    picked = F.broadcast(picked.orderBy("_order", "doc_id").limit(2 * sum(rows.values())))  # its size is bounded by `rows`
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text <> ''")
    return texts.join(picked, "doc_id").orderBy("_order", "doc_id", "text").limit(2 * sum(rows.values())).select("doc_id", "text", "label")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and distance of every document's whole text."""
    ship(docs.sparkSession)
    parts = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.least, model.scores) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _loaded(*parts.value) if parts.value else None
        for batch in batches:
            distances = np.array([measure.text(t) if measure else 0 for t in batch.column("text").to_pylist()], np.int64)
            scores = measure.scores[np.minimum(distances, len(measure.scores) - 1)] if measure else np.zeros(len(distances))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(distances)], ["doc_id", "score", "distance"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, score double, distance bigint")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    rows = labelled(docs, table(spark, sf_dir, "labels"), "toxic", {0: ORDINARY_ROWS, 1: TOXIC_ROWS}, f"not ({held})")
    model = Model.fit([(r["text"], r["label"]) for r in rows.collect()])
    return score(docs, model).select("doc_id", F.expr(f"coalesce({held}, false)").alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))
