"""Chains of audit rows, current states, alerts with a cool-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import folds

GENESIS = "0" * 64


def event_hash(*parts: Column) -> Column:
    """SHA-256 of a fixed list of columns, one separator between them."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def verify_chain(df: DataFrame, key: str, seq: str, ts: str, hashed: str, previous: str, expected: Column) -> DataFrame:
    """Rows of df that break their key's chain, a row for each violation, in the order of seq.

    hash_mismatch: the stored hash is not the expected one; chain_gap: seq is not one
    more than that before; previous_mismatch: the stored previous hash is not that of
    the row before (GENESIS for the first); time_reversed: ts is before that of the row before.
    """
    w = W.partitionBy(key).orderBy(seq)
    before = lambda c: F.lag(c).over(w)
    seen = df.withColumns({"seq_": F.coalesce(before(seq), F.lit(0)), "hash_": F.coalesce(before(hashed), F.lit(GENESIS)), "ts_": before(ts)})
    checks = {
        "hash_mismatch": F.col(hashed) != expected,
        "chain_gap": F.col(seq) != F.col("seq_") + 1,
        "previous_mismatch": ~F.col(previous).eqNullSafe(F.col("hash_")),
        "time_reversed": F.col(ts) < F.col("ts_"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return seen.withColumn("violation", F.explode(found)).drop("seq_", "hash_", "ts_")


def next_sequence(df: DataFrame, key: str, seq: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(seq).alias("last"), (F.max(seq) + 1).alias("next"))


def current_state(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """key, state of its last row, n rows."""
    return df.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n"))


def alerts(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """keys, tie: the rows that are sent on, where one sent silences its key's later ones for so many seconds. What counts is the last row sent."""
    sent = folds.decided(df.select(*keys, tie, ts), keys, ts, tie, folds.cool_down(seconds * 1_000_000), "sent_")
    return sent.filter("sent_").select(*keys, tie)
