"""Connected components of an edge table, as a loop of joins and groupings.

Alternating large-star and small-star steps (as in "Connected Components
in MapReduce and Beyond", 2014): each step hangs neighbours on the smallest
one met, and the number of rows never exceeds that of the edges plus vertices.

Defined results: edges with a null end and self-edges are left out; repeated edges
count once; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import durable

MAX_ROUNDS = 60
#: Parts over which the rows of one key are spread.
SALTS = 64


def told(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has at most a row for each value of keys.

    Facts meet each (keys, salt of spread) once and rows meet those, so however many
    rows have one key no task needs more than a SALTS-th of them.
    """
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    met = salted.select(*keys, "salt_").distinct().join(facts, keys, how)
    return salted.join(met, [*keys, "salt_"]).drop("salt_")


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u hangs on u's smallest neighbour (or u). Small: u's smaller ones and u do."""
    if large:
        around = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    else:
        around = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    met = around.join(least.withColumnRenamed("x", "at"), F.col("x") == F.col("at"))
    out = met.filter("y > x").select("y", "m") if large else met.select("y", "m").union(least.select("x", "m"))
    return out.toDF("u", "v").filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v: long)."""
    pairs = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        pairs = durable(_hang(_hang(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == before or now[0] == now[2]:
            # one parent each and no parent that hangs itself: stars
            if pairs.select("v").join(pairs.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
                break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())
