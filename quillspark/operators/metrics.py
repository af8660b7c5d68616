"""Metrics with a state: updated by batches in each task, merged by key, computed at the end."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any


import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Metric(ABC):
    """What a group's rows come to.  States must be small, since one is held for each group, and be merged in any order."""

    #: Columns of the result, as a schema.
    result: str

    @abstractmethod
    def zero(self) -> Any:
        """The state of no rows."""

    @abstractmethod
    def update(self, state: Any, rows: pd.DataFrame) -> Any:
        """The state with further rows."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """The state of the rows of two states."""

    @abstractmethod
    def compute(self, state: Any) -> dict[str, Any]:
        """Numbers by name."""


class Mean(Metric):
    """The mean of a column; lists count item by item, and nulls do not count.  `nan_value` stands for that of nothing."""

    result = "value double"

    def __init__(self, column: str, nan_value: float = 0.0) -> None:
        self.column, self.nan_value = column, nan_value

    def zero(self) -> tuple[float, int]:
        return 0.0, 0

    def update(self, state: tuple[float, int], rows: pd.DataFrame) -> tuple[float, int]:
        values = rows[self.column].explode().dropna().astype(float)
        return state[0] + float(values.sum()), state[1] + len(values)

    def merge(self, a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]

    def compute(self, state: tuple[float, int]) -> dict[str, Any]:
        return {"value": state[0] / state[1] if state[1] else self.nan_value}


class Moments(Metric):
    """Count, mean, deviation and range of a column, by the pairwise update of sums of squares, which cancels no digits."""

    result = "n bigint, mean double, deviation double, least double, most double"

    def __init__(self, column: str) -> None:
        self.column = column

    def zero(self) -> tuple[int, float, float, float | None, float | None]:
        return 0, 0.0, 0.0, None, None

    def update(self, state, rows: pd.DataFrame):
        v = rows[self.column].dropna().astype(float)
        return self.merge(state, (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()), float(v.min()), float(v.max()))) if len(v) else state

    def merge(self, a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])

    def compute(self, state) -> dict[str, Any]:
        n, mean, squares, least, most = state
        return {"n": n, "mean": mean if n else None, "deviation": (squares / (n - 1)) ** 0.5 if n > 1 else None, "least": least, "most": most}


def grouped_metric(rows: DataFrame, metric: Metric, *by: str, groups_at_once: int = 50_000) -> DataFrame:
    """by and the metric's numbers for each group.

    Each task updates the states of the groups that it meets (handing on those that it holds
    when they become many), so that a shuffle carries a state for each group and task and
    no rows, whatever share of all rows a group has.
    """
    keys = [*by] or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    key_schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    arrow_keys = pa.schema([])  # taken from the batches, so that keys keep their types

    def give(schema: pa.Schema, states: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], schema.field(c).type) for i, c in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([cloudpickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "_state"])

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, schema = {}, arrow_keys
        for batch in batches:
            schema, frame = batch.schema, batch.to_pandas()
            places = pd.Series(list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)))
            for key, own in places.groupby(places, sort=False, dropna=False):
                states[key] = metric.update(states.get(key, metric.zero()), frame.iloc[own.index])
            if len(states) > groups_at_once:
                yield give(schema, states)
                states = {}
        if states:
            yield give(schema, states)

    def merge(batch: pa.Table) -> pa.Table:
        state = metric.zero()
        for s in batch.column("_state").to_pylist():
            state = metric.merge(state, cloudpickle.loads(s))
        got = metric.compute(state)
        out = {k: batch.column(k).slice(0, 1) for k in keys} | {n: pa.array([got.get(n)], t) for n, t in types.items()}
        return pa.table(out)

    names = StructType.fromDDL(metric.result)
    types = {f.name: {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in names}
    states = rows.mapInArrow(update, f"{key_schema}, _state binary")
    return states.groupBy(*keys).applyInArrow(merge, f"{key_schema}, {metric.result}").select(*by, *types)
