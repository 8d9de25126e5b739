"""Weights learnt from feedback: after every few samples of a key they move by the mean error of its latest ones.

Means over the latest samples are windows; what a window can't say, weights that follow
from those before, is a fold over one row for each calibration, which goes by sorted.

Defined results: rows with a null prediction, truth or order are left out; a null key is
a key; a key with fewer samples than a step has no calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Samples between calibrations and looked at, the rate, and by weight: where it begins, its bounds, and how much of a step it takes.
STEP, LATEST, RATE = 10, 100, 0.01
WEIGHTS = {"hallucination": (0.40, 0.1, 0.7, 1.0), "rag_quality": (0.30, 0.1, 0.5, 0.75), "reasoning": (0.30, 0.1, 0.5, 0.75)}


def calibrations(samples: DataFrame, key: str, order: list[str], predicted: str, actual: str, step: int = STEP, latest: int = LATEST) -> DataFrame:
    """key, version (from 1), mean_error, mse, close (share within 0.05): over the latest samples, at every step-th one."""
    given = samples.dropna(subset=[predicted, actual, *order])
    by = W.partitionBy(key).orderBy(*order)
    near = by.rowsBetween(-(latest - 1), W.currentRow)
    error = F.col(predicted) - F.col(actual)
    rows = given.select(key, F.row_number().over(by).alias("n_"), F.avg(error).over(near).alias("mean_error"), F.avg(error * error).over(near).alias("mse"), F.avg((F.abs(error) < 0.05).cast("int")).over(near).alias("close"))
    return rows.filter(F.pmod("n_", F.lit(step)) == 0).select(key, F.expr(f"n_ div {step}").alias("version"), "mean_error", "mse", "close")


def moved(weights: list[float], mean_error: float, rate: float) -> list[float]:
    """Each weight a step against the error, within its bounds, then all brought to a sum of 1."""
    new = [max(low, min(high, w - mean_error * rate * share)) for w, (_, low, high, share) in zip(weights, WEIGHTS.values())]
    total = sum(new)
    return [w / total for w in new]


def learned(samples: DataFrame, key: str, order: list[str], predicted: str, actual: str, step: int = STEP, latest: int = LATEST, rate: float = RATE) -> DataFrame:
    """calibrations() with the weights after each."""
    rows = calibrations(samples, key, order, predicted, actual, step, latest).repartition(key).sortWithinPartitions(key, "version")
    out = T.StructType([*rows.schema.fields, *[T.StructField(w, T.DoubleType()) for w in WEIGHTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: list[float] = []
        for b in batches:
            after = []
            for version, error in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if version == 1:  # a key begins
                    weights = [w[0] for w in WEIGHTS.values()]
                weights = moved(weights, error, rate)
                after.append(weights)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([w[i] for w in after], pa.float64()) for i in range(len(WEIGHTS))]], [*b.schema.names, *WEIGHTS])

    return rows.mapInArrow(run, out)
