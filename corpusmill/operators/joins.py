"""Joins and windows beyond the plain ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(df: DataFrame, key: str, order: list[str], is_parent: Column, value: str, name: str) -> DataFrame:
    """df with the value of the latest parent row at or before each row of its key."""
    upto = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(F.when(is_parent, F.col(value)), ignorenulls=True).over(upto))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, deleted, modified or unchanged, of two versions."""
    o, n = old.select(F.col(key).alias("o_"), F.col(value).alias("a_")), new.select(F.col(key).alias("n_"), F.col(value).alias("b_"))
    change = F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "deleted").when(F.col("a_").eqNullSafe(F.col("b_")), "unchanged").otherwise("modified")
    return o.join(n, F.col("o_") == F.col("n_"), "full").select(F.coalesce("o_", "n_").alias(key), change.alias("change"))


def merge_three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """key, merged, conflict; a change on one side wins, different ones on both conflict."""
    b, o, t = (x.select(F.col(key).alias(f"{n}k"), F.col(value).alias(f"{n}v")) for x, n in ((base, "b"), (ours, "o"), (theirs, "t")))
    met = b.join(o, F.col("bk") == F.col("ok"), "full").withColumn("k_", F.coalesce("bk", "ok")).join(t, F.col("k_") == F.col("tk"), "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    merged = F.when(same("ov", "bv"), F.col("tv")).when(same("tv", "bv") | same("ov", "tv"), F.col("ov"))
    return met.select(F.coalesce("k_", "tk").alias(key), merged.alias("merged"), (~same("ov", "bv") & ~same("tv", "bv") & ~same("ov", "tv")).alias("conflict"))


def within_budget(df: DataFrame, key: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The leading rows of each key whose sizes add up to at most budget."""
    total = F.sum(size).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("used", total).filter(F.col("used") <= budget)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """key, score: the sum over ranked lists (key, rank) of weight / (k + rank)."""
    parts = [df.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("s").alias("score"))


def nearest_number(asked: DataFrame, known: DataFrame, key: str, block: int = 1 << 12) -> DataFrame:
    """asked with nearest, the number of known (key: integers) that is nearest, the lower of two.

    Numbers are dealt in blocks; the last known one before a block and the first after
    it stand in for all others, so no task needs more than a block.
    """
    at = F.floor(F.col(key) / block)
    blocks = known.groupBy(at.alias("b_")).agg(F.min(key).alias("lo_"), F.max(key).alias("hi_")).unionByName(asked.select(at.alias("b_")).distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy("b_").agg(F.max("lo_").alias("lo_"), F.max("hi_").alias("hi_"))
    whole = W.orderBy("b_")  # a row for each block
    ends = blocks.select("b_", F.last("hi_", True).over(whole.rowsBetween(W.unboundedPreceding, -1)).alias("before_"), F.first("lo_", True).over(whole.rowsBetween(1, W.unboundedFollowing)).alias("after_"))
    rows = asked.withColumn("is_", F.lit(False)).unionByName(known.select(key).withColumn("is_", F.lit(True)), allowMissingColumns=True).withColumn("b_", at)
    own = F.when(F.col("is_"), F.col(key))
    down, up = W.partitionBy("b_").orderBy(key, F.desc("is_")), W.partitionBy("b_").orderBy(F.desc(key), F.desc("is_"))
    seen = rows.withColumns({"lower_": F.last(own, True).over(down), "upper_": F.last(own, True).over(up)}).filter("not is_").join(ends, "b_")
    low, high = F.coalesce("lower_", "before_"), F.coalesce("upper_", "after_")
    near = F.when(high.isNull() | (F.col(key) - low <= high - F.col(key)), low).otherwise(high)
    return seen.withColumn("nearest", near).drop("is_", "b_", "lower_", "upper_", "before_", "after_")


def expand_words(df: DataFrame, key: str, text: str, synonyms: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """key, words: each word of text followed by its `most` heaviest synonyms (term, other, weight), in the order of the words."""
    terms = df.select(key, F.posexplode(F.split(text, " ")).alias("pos", "term"))
    place = F.row_number().over(W.partitionBy(key, "pos").orderBy(F.desc("weight"), "other"))
    more = terms.join(synonyms.filter(F.col("weight") >= least), "term").select(key, "pos", place.alias("r"), F.col("other").alias("word")).filter(F.col("r") <= most)
    every = terms.select(key, "pos", F.lit(0).alias("r"), F.col("term").alias("word")).unionByName(more)
    return every.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "r", "word"))), lambda x: x["word"]), " ").alias("words"))
