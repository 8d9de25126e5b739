"""Versions of records kept as full snapshots and deltas, and any version restored from them.

A record's state is rows of (path, value), to which nested values are flattened. Every
so many versions all rows are kept, in between only those that are new, changed or gone.
A stored row holds from its version to the next row of its path, so a version is restored
from the rows of its stretch (the nearest full version before it and what follows) that
hold at it: no chain is walked, and stretches of a key don't meet.

Defined results: a path whose value is null is there (as null); rows without key, version
or path are left out; of rows that repeat a path in one version the greatest value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def paths(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, path, value: a row for each leaf of a struct column, paths joined by dots; arrays and maps are leaves, as JSON."""

    def leaves(kind: T.StructType, at: Column, name: str) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            here, path = at[f.name], f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here, path + ".")
            else:
                value = F.to_json(here) if isinstance(f.dataType, T.ArrayType | T.MapType) else here.cast("string")
                out.append(F.struct(F.lit(path).alias("path"), value.alias("value")))
        return out

    every = F.array(*leaves(df.schema[column].dataType, F.col(column), ""))
    return df.select(*keys, F.explode(F.filter(every, lambda _: F.col(column).isNotNull())).alias("leaf_")).select(*keys, "leaf_.path", "leaf_.value")


def _dealt(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """By keys over so many partitions: sorts of a task stay small however many rows there are. Without a number, as Spark has it."""
    return df.repartition(parts, *columns) if parts else df


def deltas(states: DataFrame, key: str, version: str, full_every: int = 10, parts: int | None = None) -> DataFrame:
    """key, version, full, path, value, gone: what is stored of states (key, version, path, value). Versions of a key are numbered from 0 in their order; every full_every-th is full."""
    some = states.filter(F.col(key).isNotNull() & F.col(version).isNotNull() & F.col("path").isNotNull()).select(key, version, "path", "value")
    # one shuffle by key serves all of what follows
    rows = _dealt(some, parts, key).groupBy(key, version, "path").agg(F.max("value").alias("value"))
    by_key, later = W.partitionBy(key).orderBy(version), W.partitionBy(key).orderBy(F.desc(version))
    # of rows from the last version down, those where a version begins know the one after it
    after = F.lag(version).over(later)
    told = rows.withColumns({"n_": F.dense_rank().over(by_key) - 1, "after_": F.when(after != F.col(version), after)})
    at = told.withColumn("next_", F.last("after_", True).over(later.rowsBetween(W.unboundedPreceding, W.currentRow)))
    mine = W.partitionBy(key, "path").orderBy("n_")
    seen = at.withColumns({"was_": F.lag("value").over(mine), "was_n_": F.lag("n_").over(mine), "then_n_": F.lead("n_").over(mine)})
    full = F.pmod("n_", F.lit(full_every)) == 0
    fresh = F.col("was_n_").isNull() | (F.col("was_n_") < F.col("n_") - 1) | ~F.col("value").eqNullSafe(F.col("was_"))
    # a path is gone at the next version where that has no row for it, unless that one is full
    ended = F.col("next_").isNotNull() & (F.col("then_n_").isNull() | (F.col("then_n_") > F.col("n_") + 1)) & (F.pmod(F.col("n_") + 1, F.lit(full_every)) != 0)
    kept_row = F.struct(F.col(version).alias("v"), full.alias("full"), F.col("value").alias("value"), F.lit(False).alias("gone"))
    gone_row = F.struct(F.col("next_").alias("v"), F.lit(False).alias("full"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("gone"))
    made = seen.select(key, "path", F.explode(F.array_compact(F.array(F.when(full | fresh, kept_row), F.when(ended, gone_row)))).alias("s_"))
    return made.select(key, F.col("s_.v").alias(version), "s_.full", "path", "s_.value", "s_.gone")


def restore(stored: DataFrame, asked: DataFrame, key: str, version: str, parts: int | None = None) -> DataFrame:
    """key, version, path, value of every (key, version) of asked, from what deltas() gives; a version before the first full one has no rows."""
    so_far = W.partitionBy(key).orderBy("at_").rangeBetween(W.unboundedPreceding, W.currentRow)
    base = F.max(F.when(F.col("full"), F.col("at_"))).over(so_far)
    fulls = stored.filter("full").select(key, F.col(version).alias("at_"), F.lit(True).alias("full"))
    marks = fulls.unionByName(asked.select(key, F.col(version).alias("at_"), F.lit(False).alias("full")))
    wanted = _dealt(marks, parts, key).distinct().withColumn("base_", base).filter("not full and base_ is not null").select(key, "base_", F.col("at_").alias("asked_"))
    follows = F.lead("at_").over(W.partitionBy(key, "base_", "path").orderBy("at_"))
    held = stored.withColumnRenamed(version, "at_").withColumn("base_", base).filter("base_ is not null").withColumn("till_", follows).filter("not gone").select(key, "base_", "path", "value", "at_", "till_")
    met = _dealt(held, parts, key, "base_").join(_dealt(wanted, parts, key, "base_").hint("merge"), [key, "base_"])
    return met.filter("at_ <= asked_ and (till_ is null or asked_ < till_)").select(key, F.col("asked_").alias(version), "path", "value")


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, path, old, new of every difference of two versions (key, path, value), and key's likeness: 1 less differences over the paths of a, at least 0."""
    x, y = a.select(key, "path", F.col("value").alias("old"), F.lit(True).alias("in_a_")), b.select(key, "path", F.col("value").alias("new"), F.lit(True).alias("in_b_"))
    both = x.join(y, [key, "path"], "full")
    differs = F.col("in_a_").isNull() | F.col("in_b_").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    of = both.groupBy(F.col(key).alias("k_")).agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.count_if(differs) / F.greatest(F.count("in_a_"), F.lit(1))).alias("likeness"))
    return both.filter(differs).join(of, F.col(key) == F.col("k_")).select(key, "path", "old", "new", "likeness")
