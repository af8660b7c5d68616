"""Rewards by name: functions of a row or of a batch, registered here or loaded from a file, run in Arrow batches."""

from __future__ import annotations

import importlib.util
import inspect
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row for a reward: response, response_length, ground_truth, and further columns by name.
Row = dict


@dataclass(frozen=True)
class Reward:
    """A reward function: `kind` says whether it takes a row (`sequential`) or a list of rows (`batch`).  It gives numbers by name, of which `overall` is one."""

    name: str
    function: Callable
    kind: str = "batch"
    outputs: tuple[str, ...] = ("overall",)

    def __post_init__(self) -> None:
        if self.kind not in ("batch", "sequential"):
            raise ValueError(f"unsupported kind of reward: {self.kind}")

    def of(self, rows: list[Row]) -> list[dict]:
        got = [self.function(r) for r in rows] if self.kind == "sequential" else self.function(rows)
        if len(got) != len(rows):
            raise ValueError(f"{self.name} gave {len(got)} scores for {len(rows)} rows")
        return got


@dataclass
class Registry:
    """Rewards by name."""

    known: dict[str, Reward] = field(default_factory=dict)

    def add(self, name: str, kind: str = "batch", outputs: tuple[str, ...] = ("overall",)) -> Callable[[Callable], Callable]:
        """Register a function under a name."""

        def put(f: Callable) -> Callable:
            if name in self.known:
                raise ValueError(f"reward {name} is registered twice")
            self.known[name] = Reward(name, f, kind, outputs)
            return f

        return put

    def get(self, name: str, **options) -> Reward:
        """The reward of a name, its function with the given options."""
        if name not in self.known:
            raise KeyError(f"no reward {name}; there are {', '.join(sorted(self.known))}")
        r = self.known[name]
        return Reward(r.name, partial(r.function, **options) if options else r.function, r.kind, r.outputs)


REWARDS = Registry()


def load_reward(path: str, function: str, **options) -> Reward:
    """The reward of a Python file: the function, and what the file says as REWARD_NAME, REWARD_TYPE (batch or sequential) and REWARD_OUTPUTS."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no file {path} with a reward")
    spec = importlib.util.spec_from_file_location(f"reward_{uuid.uuid4().hex}", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        del sys.modules[spec.name]
        raise RuntimeError(f"{path} cannot be loaded: {e}") from e
    if not hasattr(module, function):
        raise AttributeError(f"{path} has no function {function}")
    cloudpickle.register_pickle_by_value(module)  # executors do not have the file
    f = getattr(module, function)
    return Reward(getattr(module, "REWARD_NAME", function), partial(f, **options) if options else f, getattr(module, "REWARD_TYPE", "batch"), tuple(getattr(module, "REWARD_OUTPUTS", ("overall",))))


def with_reward(rows: DataFrame, reward: Reward, response: Column, ground_truth: Column, length: Column | None = None, name: str | None = None, **further: Column) -> DataFrame:
    """Rows with a struct of the reward's numbers, as a column of its name; a number that a row is not given is null."""
    given = {"response": response, "response_length": F.length(response) if length is None else length, "ground_truth": ground_truth, **further}
    schema = ", ".join(f"`{o}` double" for o in reward.outputs)

    @F.pandas_udf(schema)
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            clean = frame.astype(object).where(frame.notna(), None)
            got = reward.of(clean.to_dict("records"))
            yield pd.DataFrame([{o: g.get(o) for o in reward.outputs} for g in got], columns=list(reward.outputs)).astype("float64")

    return rows.withColumn(name or reward.name, scored(F.struct(*(c.alias(k) for k, c in given.items()))))


def weighted(rows: DataFrame, parts: dict[str, float], name: str = "reward") -> DataFrame:
    """Rows with the sum of the rewards' overall numbers by weight; nulls count nothing, and with no number at all it is null."""
    values = [F.col(p)["overall"] for p in parts]
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, parts.values(), strict=True)), F.lit(0.0))
    return rows.withColumn(name, F.when(F.coalesce(*values).isNotNull(), total))


def describe(reward: Reward) -> str:
    """Name, kind and outputs of a reward, and the options that its function takes."""
    options = [p for p in list(inspect.signature(reward.function).parameters)[1:]]
    return f"{reward.name} ({reward.kind}): {', '.join(reward.outputs)}" + (f"; options {', '.join(options)}" if options else "")
