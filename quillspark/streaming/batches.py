"""Streams that fill batches with groups worth learning from, over several tries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_ROW = "try_no int, of int, uid string, sample bigint, score double"
FILLED = "batch string, sample bigint, uid string, score double, tries int, outcome string"


class NothingKept(RuntimeError):
    """A batch that cannot be filled."""


def spread(scores: list[float]) -> bool:
    """Whether a group's scores differ."""
    return max(scores) > min(scores)


def between(low: float, high: float):
    """A rule: whether a group's mean score lies strictly between."""
    return lambda scores: low < sum(scores) / len(scores) < high


class FillBatches(StatefulProcessor):
    """Keeps the groups of each try that a rule takes until there are `size` samples.

    The state of a batch is the samples kept so far, the first try (which comes out if nothing
    else fills the batch), and rows of a try that is not whole yet.  What waits longer than
    `patience_ms` is given up.
    """

    def __init__(self, size: int, most: int, rule, strict: bool, patience_ms: int | None) -> None:
        self.size, self.most, self.rule, self.strict, self.patience_ms = size, most, rule, strict, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int, done boolean")
        self.kept, self.first, self.open = (handle.getListState(x, _ROW) for x in ("kept", "first", "open"))

    def _out(self, key: tuple, rows: list[tuple], tries: int, outcome: str) -> pd.DataFrame:
        for state in (self.kept, self.first, self.open):
            state.clear()
        self._forget_timers()
        self.tries.update((tries, True))
        return pd.DataFrame([(key[0], sample, uid, score, tries, outcome) for _, _, uid, sample, score in rows], columns=["batch", "sample", "uid", "score", "tries", "outcome"])

    def _forget_timers(self) -> None:
        if self.patience_ms is not None:
            for at in [*self.handle.listTimers()]:
                self.handle.deleteTimer(at)

    @staticmethod
    def _rows(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tries, done = self.tries.get() if self.tries.exists() else (0, False)
        new = [(int(a), int(b), c, int(d), float(e)) for r in rows for a, b, c, d, e in r[["try_no", "of", "uid", "sample", "score"]].itertuples(index=False)]
        if done:  # tries that come late
            return
        waiting, kept = self._rows(self.open) + new, self._rows(self.kept)
        while (own := [r for r in waiting if r[0] == tries + 1]) and len(own) >= own[0][1]:
            own.sort(key=lambda r: (r[2], r[3]))
            waiting = [r for r in waiting if r[0] > tries + 1]
            tries += 1
            if tries == 1:
                self.first.put(own)
            groups: dict[str, list[tuple]] = {}
            for r in own:
                groups.setdefault(r[2], []).append(r)
            taken = [r for g in groups.values() if self.rule([x[4] for x in g]) for r in g]
            if self.strict and not taken:
                raise NothingKept(f"no sample of try {tries} of batch {key[0]} is kept")
            kept += taken
            if len(kept) >= self.size:
                yield self._out(key, kept[: self.size], tries, "filled")
                return
            if 0 < self.most <= tries:
                if self.strict:
                    raise NothingKept(f"batch {key[0]} has {len(kept)} of {self.size} samples after {tries} tries")
                yield self._out(key, self._rows(self.first), tries, "fallback")
                return
        self.tries.update((tries, False))
        self._keep(self.kept, kept)
        self._keep(self.open, waiting)
        if self.patience_ms is not None:
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tries, done = self.tries.get() if self.tries.exists() else (0, False)
        if not done:
            if self.strict:
                raise NothingKept(f"batch {key[0]} waited too long after {tries} tries")
            yield self._out(key, self._rows(self.first) or self._rows(self.open), tries, "fallback")

    def close(self) -> None:
        pass


def fill_batches(stream: DataFrame, size: int, most: int, rule=spread, strict: bool = False, patience_ms: int | None = None) -> DataFrame:
    """batch, sample, uid, score, tries, outcome (filled or fallback) for a stream of batch, try_no (from 1), of (how many rows the try has), uid, sample, score.

    Samples of the groups (uid) that the rule takes are gathered over tries, in the order of try,
    group and sample, until there are `size`; further ones are left.  After `most` tries (0: no
    limit) the first try comes out whole, or, if strict, the query fails; if strict it fails too
    when a try keeps nothing.  A try counts once all its rows are there, in whatever batches of
    the stream they come.  With `patience_ms` a batch that nothing comes for is ended.
    """
    keyed = stream.selectExpr("cast(batch as string) as batch", "cast(try_no as int) as try_no", "cast(of as int) as of", "cast(uid as string) as uid", "cast(sample as bigint) as sample", "cast(score as double) as score").groupBy("batch")
    return keyed.transformWithStateInPandas(FillBatches(size, most, rule, strict, patience_ms), FILLED, "append", "None" if patience_ms is None else "ProcessingTime")
