"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: every source is due its share of all words by weight, but
at most max_epochs times its own size; what is cut off goes to the others by
weight, until none is above its cap. Sources in order of cap over weight are
capped one after another, so the fixed point is found by running sums over the
table of sources.

Sampling: the whole part of target/size is repeated for every document of the
source; the rest is filled with documents in the order of a seeded hash, the last
of them in part, so that a source's words meet its target to the word. The order
is cut in slices (source, first hash digits): running sums over slices place a
slice, and running sums within it place a document, so that no task needs a whole
source.

Defined results: the size of null and empty texts is 0 and nothing is taken of
them; sources sort by code point, a null source is a source and comes last;
without words all targets are 0; rows that repeat are separate documents, placed
one after another; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash digits that name a slice of a source: 16^3 slices.
SLICE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Adds weight: the given weights in turn, sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight -> and target."""
    cap = F.col("source_size") * F.lit(max_epochs)
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everyone = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    # the level at which this source and all after it would be filled, were those before it capped
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(upto), F.lit(0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    filled = sources.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    # levels rise up to the first source that is not capped and fall after it: it sets the level for the rest
    at = F.max(F.when(F.col("free"), F.col("level"))).over(everyone)
    return filled.withColumn("target", F.least(cap.cast("double"), F.coalesce(at, F.lit(float("inf"))) * F.col("weight"))).drop("level", "free")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole repetitions), part (words of a partial one), taken."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return place(sized, weights, max_epochs, seed)


def place(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """mix() for documents whose size (words) is known; all other columns are carried."""
    hashed = sized.withColumn("u", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("slice", F.substring("u", 1, SLICE_DIGITS))
    slices = hashed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = water_fill(cycling_weights(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights), max_epochs)
    by_slice = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    due = sources.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    placed = slices.withColumn("before_slice", F.coalesce(F.sum("slice_size").over(by_slice), F.lit(0)))
    told = placed.join(due, placed["source"].eqNullSafe(due["source"])).select(
        placed["source"].alias("s_"), F.col("slice").alias("slice_"), "before_slice", "source_size", "target", "epochs", "rest"
    )
    within = W.partitionBy("source", "slice").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before_slice") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return (
        hashed.join(told, hashed["source"].eqNullSafe(told["s_"]) & (hashed["slice"] == told["slice_"]))
        .withColumn("part", part.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("u", "slice", "s_", "slice_", "before_slice", "rest")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(n, F.lit(1)).cast("int")), "")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, whole ones repeated, one of each source cut to the words still due."""
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    counted = place(row, **how)
    whole = F.col("epochs") + (F.col("part") == F.col("size")).cast("int")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.when(cut, F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array(F.lit(True)))).otherwise(F.array_repeat(F.lit(False), whole.cast("int")))
    out = counted.filter("taken > 0").select("row", "part", F.explode(copies).alias("cut_"))
    text = F.when(F.col("cut_"), first_words(F.col(f"row.{text_col}"), F.col("part"))).otherwise(F.col(f"row.{text_col}"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns])
