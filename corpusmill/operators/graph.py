"""Graphs as edge tables (src, dst). Levels are joins; lineage is cut every few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import durable


#: Edges of a partition, about, where they are laid out for levels to meet.
PART = 200_000


def laid(edges: DataFrame) -> DataFrame:
    """Distinct edges, dealt and sorted by src and kept so: a level brings its front to them, they are not made, shuffled or sorted again."""
    pairs, conf = edges.select("src", "dst"), edges.sparkSession.conf
    sorted_ = pairs.repartition(1 + pairs.count() // PART, "src").distinct().sortWithinPartitions("src")
    # an adaptive plan does not say how its rows lie, and they would be shuffled again at each level
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return durable(sorted_)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, level: how many edges lead from the nearest start (node) to every node within depth. Each level visits only new nodes."""
    return _reach(laid(edges), starts, depth)


def _reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    seen = starts.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        # fronts and what is seen grow with the graph, so nothing goes through the driver
        step = front.join(edges.hint("merge"), front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = durable(step.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, level, before: as reach, with the smallest node from which a shortest path comes."""
    edges = laid(edges)
    found = durable(_reach(edges, starts, depth))
    last = found.select(F.col("node").alias("src"), (F.col("level") + 1).alias("level"))
    steps = last.join(edges.hint("merge"), "src").select(F.col("dst").alias("node"), "level", "src").groupBy("node", "level").agg(F.min("src").alias("before"))
    return found.join(steps.hint("merge"), ["node", "level"], "left")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in: distinct neighbours either way."""
    pairs = edges.select("src", "dst").distinct()
    sides = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select("dst", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def chain_depths(edges: DataFrame) -> DataFrame:
    """node, depth: nodes of the longest chain of references that begins at each node (1 without any); null for a node from which a cycle is reached. An edge from a node to itself is left out.

    Nodes without an open reference are done and close the references to them, so every
    edge leaves once, in as many rounds as the longest chain has nodes.
    """
    left = durable(edges.select("src", "dst").filter("src <> dst").distinct())
    node = lambda df, c: df.select(F.col(c).alias("node"))
    front = durable(node(left, "dst").distinct().join(node(left, "src").hint("merge"), "node", "left_anti").withColumn("depth", F.lit(1)))
    every, depth = front, 1
    while not front.isEmpty():
        depth += 1
        done = node(front, "node").withColumnRenamed("node", "dst")
        closed = left.join(done.hint("merge"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        left = durable(left.join(done.hint("merge"), "dst", "left_anti").select("src", "dst"))
        front = durable(closed.join(node(left, "src").hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        every = every.unionByName(front)
    return every.unionByName(node(left, "src").distinct().withColumn("depth", F.lit(None).cast("int")))


def cyclic(edges: DataFrame) -> DataFrame:
    """node, length: nodes that lead back to themselves, with the fewest edges that do, however many.

    Nodes without an edge in or out are taken off first, as often as any is left; then
    every node of what remains is followed until it meets itself, so the work grows with
    the square of the cyclic part.
    """
    pairs = durable(edges.select("src", "dst").distinct())
    n, before = pairs.count(), -1
    while n != before:
        ends = pairs.select(F.col("src").alias("n")).join(pairs.select(F.col("dst").alias("n")), "n", "left_semi").distinct()
        pairs = durable(pairs.join(ends.select(F.col("n").alias("src")), "src", "left_semi").join(ends.select(F.col("n").alias("dst")), "dst", "left_semi"))
        n, before = pairs.count(), n
    length = 1
    front = durable(pairs.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(length).alias("length")))
    seen, found = front, front.filter("start = node").select("node", "length")
    met = found.select(F.col("node").alias("start"))
    while not front.isEmpty():
        length += 1
        # a start that has met itself needs no further steps
        going = front.join(met, "start", "left_anti")
        step = going.join(pairs, going["node"] == pairs["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = durable(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("length", F.lit(length)))
        back = front.filter("start = node")
        found = found.unionByName(back.select("node", "length"))
        met = back.select("start")
        seen = seen.unionByName(front)
    return found


def trust(edges: DataFrame, nodes: DataFrame, terminal: Column, depth: int = 5) -> DataFrame:
    """node, trust, n_paths: the mean, over all simple paths of at most depth edges to a terminal node, of the product of the nodes' credibility (node, credibility).

    A node without such a path has its own credibility. Paths are rows; each edge is
    one join, and a path never comes to a node again.
    """
    score = nodes.select(F.col("node").alias("dst"), F.col("credibility").alias("more"), terminal.alias("ends"))
    front = nodes.select("node", F.array("node").alias("path"), F.col("credibility").alias("product"), F.col("node").alias("at"), terminal.alias("ends"))
    done = front.filter("ends").select("node", "product")
    steps = edges.select("src", "dst").distinct().join(score, "dst")
    for _ in range(depth):
        met = front.join(steps.withColumnRenamed("ends", "now"), F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = durable(met.select("node", F.concat("path", F.array("dst")).alias("path"), (F.col("product") * F.col("more")).alias("product"), F.col("dst").alias("at"), F.col("now").alias("ends")))
        done = done.unionByName(front.filter("ends").select("node", "product"))
    means = done.groupBy("node").agg(F.avg("product").alias("mean"), F.count("*").alias("n_paths"))
    return nodes.join(means, "node", "left").select("node", F.coalesce("mean", "credibility").alias("trust"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"))
