"""Decisions on events that depend on those taken before: limits on rates, calls in a period, and cool-downs, by key.

Rows are dealt by key and sorted by time within their partition, and go by as a stream:
of a key a task holds what its rule remembers (the times allowed within a period, at
most), never its rows. A refused event is not counted.

Defined results: null keys are one key; rows without a time are neither allowed nor
counted and get null; equal times are taken in the order of `tie`; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(Protocol):
    """What is remembered of a key: take() says whether an event at this time (microseconds) is allowed; memory is all of the state, as times."""

    memory: list[int]

    def take(self, at: int) -> bool: ...


class Rate:
    """At most `most` allowed events within a period that ends with each."""

    def __init__(self, most: int, micros: int, memory: list[int] | None = None):
        self.most, self.micros, self.held = most, micros, deque(memory or [])

    def take(self, at: int) -> bool:
        while self.held and self.held[0] <= at - self.micros:
            self.held.popleft()
        if len(self.held) >= self.most:
            return False
        self.held.append(at)
        return True

    @property
    def memory(self) -> list[int]:
        return list(self.held)

    @property
    def until(self) -> int:
        """When nothing of this is needed any more."""
        return self.held[-1] + self.micros if self.held else 0


class Calls(Rate):
    """At most `most` events in a period that the first of them opens; the next event after it opens another."""

    def take(self, at: int) -> bool:
        if self.held and at >= self.held[0] + self.micros:
            self.held.clear()
        if len(self.held) >= self.most:
            return False
        self.held.append(at)
        return True

    @property
    def until(self) -> int:
        return self.held[0] + self.micros if self.held else 0


def cool_down(micros: int) -> Callable[[], Rate]:
    """One event silences later ones for so long."""
    return lambda: Rate(1, micros)


def decided(df: DataFrame, keys: list[str], ts: str, tie: str, rule: Callable[[], Rule], name: str = "allowed") -> DataFrame:
    """df with a boolean column `name`, which takes the place of one that df has: is the event allowed?"""
    kept = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.unix_micros(F.col(ts).cast("timestamp")).alias("at_")).repartition(*keys).sortWithinPartitions(*keys, "at_", tie)
    places = [kept.index(k) for k in keys]
    out = T.StructType([*rows.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Rule | None = None
        for b in batches:
            said: list[bool | None] = []
            for *key, at in zip(*(b.column(i).to_pylist() for i in (*places, b.num_columns - 1))):
                if state is None or tuple(key) != now:
                    now, state = tuple(key), rule()
                said.append(None if at is None else state.take(at))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.bool_())], [*b.schema.names[:-1], name])

    return rows.mapInArrow(run, out)
