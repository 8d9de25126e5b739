"""Aggregates that the built-in ones don't give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import durable

BUCKETS = 100


def matching(df: DataFrame, **equal) -> DataFrame:
    """Optional conditions joined by and: None is no condition, a list means membership."""
    given = [F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v for k, v in equal.items() if v is not None]
    return df.filter(reduce(Column.__and__, given)) if given else df


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """by, and for each share p the value at place min(floor(n p), n - 1) from 0 in sorted order.

    Equal values are counted first. Counts are put in buckets whose bounds are
    approximate quantiles of each group, so however heavy a tail is, only a bucket's
    distinct values are ordered, never a whole group. The bounds depend on the order in
    which partial results are merged, so they are written once: rows placed by one set
    of bounds and counted by another would miss their place.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g_"), F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    cuts = [i / buckets for i in range(1, buckets)]
    span = durable(rows.groupBy(F.col("g_").alias("h_")).agg(F.percentile_approx("v_", cuts, 10 * buckets).alias("cuts_"), F.sum("c_").alias("n_")))
    bucket = F.size(F.filter("cuts_", lambda x: x < F.col("v_")))
    placed = rows.join(span, F.col("g_").eqNullSafe(F.col("h_"))).select("g_", "v_", "c_", "n_", bucket.alias("b_"))
    counts = placed.groupBy("g_", "b_").agg(F.sum("c_").alias("k_"), F.max("n_").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("k_").over(W.partitionBy("g_").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n_") * p), F.col("n_") - 1).alias("at")) for k, p in shares.items()]))
    wanted = before.select("*", asked.alias("p_")).filter("p_.at >= before_ and p_.at < before_ + k_")
    wanted = wanted.select(F.col("g_").alias("wg_"), F.col("b_").alias("wb_"), F.col("p_.name").alias("name_"), (F.col("p_.at") - F.col("before_")).alias("rank_"))
    found = placed.join(wanted, F.col("g_").eqNullSafe(F.col("wg_")) & (F.col("b_") == F.col("wb_")))
    upto = F.sum("c_").over(W.partitionBy("g_", "b_", "name_").orderBy("v_").rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = found.withColumn("upto_", upto).filter("rank_ < upto_ and rank_ >= upto_ - c_")
    return hit.groupBy(F.col("g_").alias(by)).agg(*[F.max(F.when(F.col("name_") == k, F.col("v_"))).alias(k) for k in shares])


def z_outliers(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose distance from the mean is over threshold sample deviations, with z and score min(|z|/5, 1)."""
    base = df.agg(F.avg(value).alias("mean_"), F.stddev_samp(value).alias("sd_"))  # one row
    z = (F.col(value) - F.col("mean_")) / F.col("sd_")
    return df.join(F.broadcast(base)).filter(F.col("sd_") > 0).withColumn("z", z).filter(F.abs("z") > threshold).withColumn("score", F.least(F.abs("z") / 5, F.lit(1.0))).drop("mean_", "sd_")


def iqr_outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows beyond 1.5 quartile distances of their group."""
    q = nearest_rank(df, by, value, {"q1_": 0.25, "q3_": 0.75}).withColumnRenamed(by, "k_")
    reach = 1.5 * (F.col("q3_") - F.col("q1_"))
    return df.join(q, F.col(by).eqNullSafe(F.col("k_"))).filter((F.col(value) < F.col("q1_") - reach) | (F.col(value) > F.col("q3_") + reach)).drop("k_", "q1_", "q3_")


def value_type(x: Column) -> Column:
    return F.when(x.rlike(r"^-?[0-9]+$"), "int").when(x.rlike(r"^-?[0-9]+[.][0-9]+$"), "float").otherwise("string")


def modal_share(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """by, n, and the share of the most frequent kind."""
    each = df.groupBy(*by, kind).agg(F.count("*").alias("c_"))
    return each.groupBy(*by).agg(F.sum("c_").alias("n"), F.round(F.max("c_") / F.sum("c_"), 6).alias("modal_share"))


def baseline(df: DataFrame, by: str, value: str, places: int = 6) -> DataFrame:
    """by, n, mean, deviation (sample), least, most."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), places).alias("mean"), F.round(F.stddev_samp(value), places).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))


def retries(df: DataFrame, tries: str, ts: str, now: str, most: int = 5, days: int = 7) -> DataFrame:
    """Adds wait_minutes (2 to the number of tries, 60 at most) and retry: fewer than `most` tries, not older than `days`."""
    wait = F.least(F.pow(F.lit(2.0), F.col(tries)), F.lit(60.0)).cast("int")
    return df.withColumns({"wait_minutes": wait, "retry": (F.col(tries) < most) & (F.col(ts) + F.expr(f"INTERVAL {days} DAYS") > F.col(now))})
