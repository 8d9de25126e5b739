"""Limits of rates and cool-downs on streams: keyed state with event-time timers.

The state of a key is what its rule remembers (operators/folds.py). A timer fires when
the watermark has passed the time until which that matters, and the state goes, so only
keys with recent events hold any. A query that starts again from its checkpoint goes on
with the state it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.folds import Rate

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Limiter(StatefulProcessor):
    """rule: makes the state of a key from the times that it remembers."""

    def __init__(self, rule: Callable[[list[int]], Rate], columns: list[str]):
        self.rule, self.columns = rule, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", T.StructType([T.StructField("held", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = list(self.times.get()[0]) if self.times.exists() else []
        state = self.rule(held)
        given = pd.concat(list(rows)).sort_values(["at_", "tie_"], kind="stable")
        said = [state.take(int(at)) for at in given["at_"]]
        self.times.update((state.memory,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-state.until // 1000))
        yield given.assign(allowed=said)[[*self.columns, "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.times.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def decided(stream: DataFrame, keys: list[str], ts: str, tie: str, rule: Callable[[list[int]], Rate], late: str = "10 minutes") -> DataFrame:
    """The stream's rows with `allowed`; a key's rows of one batch are taken by time, and batches in the order in which they come. Rows without a time are left out."""
    stream.sparkSession.conf.set(*PROVIDER)
    columns = [c for c in stream.columns if c != "allowed"]
    rows = stream.select(*columns).withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    out = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])
    rows = rows.withColumns({"at_": F.unix_micros(ts), "tie_": F.col(tie)})
    return rows.groupBy(*keys).transformWithStateInPandas(Limiter(rule, columns), outputStructType=out, outputMode="Append", timeMode="EventTime")
