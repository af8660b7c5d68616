"""Quality rules (operator 2): decision lists learned by sequential covering.

Statistics of whole texts are gathered in one pass.  From labelled rows (a bounded sample)
the learner grows one conjunction of thresholds at a time, by information gain, until it
covers no good text of the growing part; prunes it on the other part; sets aside what it
covers; and goes on while a rule is still worth having.  The list is emitted as one ordered
`when` chain over the statistics, so that applying it costs no Python.

The learner reads about `SAMPLE_ROWS` labelled rows, chosen by a hash of doc_id, and the list
has at most `MOST_RULES` rules of `MOST_CONDITIONS` conditions: bounds of the method, which
keep a list readable.  Every document is judged whole.

Edge cases: null text has no words, and so fails the base rule; very long texts are counted
whole, in time linear in their length; of conditions of equal gain the first feature in order
and its least threshold win; without labelled rows of both kinds the list is empty and the
base rule decides alone; rows that share a doc_id are judged each by their own text, and all
of them teach; a null doc_id is judged but teaches nothing; repeated rows are judged each; an
empty table gives an empty result; extra columns are not looked at, and with `keep_row` come
out as fields of `_row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import words
from quillspark.llm.common import ship, slices, table, with_row

SAMPLE_ROWS = 12_000
#: A list is short enough to read: so many rules, of so many conditions each, at most.  Rules come in the order of their gain, so what is left out covers least.
MOST_RULES, MOST_CONDITIONS = 12, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct"]

#: What conditions are about, as SQL over the counts; every one is defined for a text without words.
FEATURES = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
BASE_FAILED = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"


def counts(data: np.ndarray, offsets: np.ndarray, repeat: int = 8) -> list[np.ndarray]:
    """The counts of each row, in the order of _COUNTS."""
    starts, ends, first = words.spans(data, offsets)
    fp = words.fingerprints(data, starts, ends)
    n_words = np.diff(first)

    def per_row(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, starts, 1)
    np.add.at(in_word, ends, -1)
    lead = (data & 0xC0) != 0x80
    word_chars = per_row((np.cumsum(in_word[:-1]) > 0) & lead)
    after_c3 = np.append(False, data[:-1] == 0xC3)
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    # lines with a word: the words of a line share the number of line ends before them
    line = np.cumsum(np.append(0, data[:-1] == 10)) if len(data) else np.zeros(0, np.int64)
    n_lines, n_dup, n_repeat, n_distinct = (np.zeros(len(n_words), np.int64) for _ in range(4))
    whole = words.windows(fp, repeat)
    text = data.tobytes()
    for i in range(len(n_words)):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        n_distinct[i] = len(np.unique(fp[a:b]))
        row = text[offsets[i] : offsets[i + 1]]
        own = line[starts[a:b]]
        with_word = np.unique(own) - line[offsets[i]]
        parts = row.split(b"\n")
        lines = [parts[k] for k in with_word.tolist()]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
        if b - a >= repeat:
            _, inverse, times = np.unique(whole[a : b - repeat + 1], return_inverse=True, return_counts=True)
            if times.max() > 1:
                n_repeat[i] = words.cover(b - a, np.flatnonzero(times[inverse] > 1), repeat).sum()
    return [n_words, word_chars, per_row(_SYMBOL[data]), n_dup, n_repeat, n_lines, per_row(upper), per_row(data == ord("!")), n_distinct]


def statistics(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id and the counts of every document's whole text; with `keep_row` also `_row`, its columns as they came."""
    ship(docs.sparkSession)
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = with_row(docs, own[0]) if keep_row else docs.select(*own)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(c.astype(np.int64)) for c in counts(data, offsets))], [*kept, *_COUNTS])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in _COUNTS)]))


@dataclass(frozen=True)
class Condition:
    """feature <= threshold, or feature > threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Which rows meet it."""
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        """The condition over the counts."""
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while (~bad & live).any() and len(rule) < MOST_CONDITIONS:
        p, n = int((bad & live).sum()), int((~bad & live).sum())
        best, gain = None, 1e-9
        for f, values in x.items():
            own = values[live]
            order = np.argsort(own, kind="stable")
            v, y = own[order], bad[live][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut) == 0:
                continue
            upto = np.cumsum(y)[cut]
            size = cut + 1
            for above, pos, total in ((False, upto, size), (True, p - upto, p + n - size)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / total) - np.log2(p / (p + n))), 0.0)
                k = int(g.argmax())
                if g[k] > gain:
                    best, gain = Condition(f, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)), float(g[k])
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return tuple(rule)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that name bad rows."""
    rules: list[Rule] = []
    n = len(bad)
    grow_part = np.arange(n) % 3 != 2
    left = np.ones(n, bool)
    while len(rules) < MOST_RULES and (bad & left & grow_part).any():
        g = left & grow_part
        rule = _grow({f: v[g] for f, v in x.items()}, bad[g])
        if not rule:
            break
        h = left & ~grow_part
        hx, hy = {f: v[h] for f, v in x.items()}, bad[h]

        def worth(r: Rule, hx: dict[str, np.ndarray] = hx, hy: np.ndarray = hy) -> float:
            c = _covers(r, hx, len(hy))
            return (int((c & hy).sum()) - int((c & ~hy).sum())) / max(1, int(c.sum()))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        covered = _covers(rule, x, n) & left
        good, found = int((covered & ~bad).sum()), int((covered & bad).sum())
        if found < max(2, 0.005 * bad.sum()) or good > 0.1 * found:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """kept by the list, as one ordered conditional expression over the counts."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        c = F.expr(" and ".join(x.sql() for x in rule))
        chain = F.when(c, F.lit(False)) if chain is None else chain.when(c, F.lit(False))
    return chain.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from about `rows` labelled documents, chosen by a hash of doc_id."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = own.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
    picked = F.broadcast(own.withColumn("_order", order).where(F.col("_order") < min(1.0, rows / max(1, n))).limit(2 * rows))  # its size is bounded by `rows`
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(picked.select("doc_id"), "doc_id", "left_semi")
    got = statistics(sample).join(picked, "doc_id").orderBy("_order", *_COUNTS).limit(2 * rows).selectExpr("quality", *(f"{sql} as {f}" for f, sql in FEATURES.items())).toPandas()
    if got.empty:
        return []
    return learn_rules({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], keep_row: bool = False) -> DataFrame:
    """The statistics with base_failed and kept."""
    out = statistics(docs, keep_row).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *_COUNTS[:5], "base_failed", "kept")
