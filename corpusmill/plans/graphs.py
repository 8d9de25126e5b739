"""Paths, chains, cycles, trust and lineage over edges made from parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.plans.corpus import _EDGES, _edges, _links
from corpusmill.plans.registry import query
from corpusmill.session import table


@query(
    f"WITH RECURSIVE d AS ({_EDGES}), e AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), p AS (SELECT 's1' AS node, 0 AS level UNION SELECT dst, level + 1 FROM p JOIN e ON src = node WHERE level < 3), l AS (SELECT node, min(level) AS level FROM p GROUP BY node) "
    "SELECT l.node, l.level, min(b.node) AS before FROM l LEFT JOIN e ON e.dst = l.node LEFT JOIN l b ON b.node = e.src AND b.level = l.level - 1 GROUP BY ALL"
)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From one node to all within three edges, either way: how far, and by which neighbour."""
    e = _links(spark, d)
    return graph.paths(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), spark.range(1).select(F.lit("s1").alias("node")), 3)


_DAG = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0"


def _dag(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"))
    return p.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst")).distinct()


@query(f"WITH RECURSIVE e AS ({_DAG}), c AS (SELECT 0::BIGINT AS node, 1 AS depth UNION SELECT src, depth + 1 FROM c JOIN e ON dst = node) SELECT node, max(depth) AS depth FROM c GROUP BY node")
def chain_depths(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_depths(_dag(spark, d))


@query("WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 60 AS src, (p_partkey % 60) * 7 % 60 AS dst FROM part), c AS (SELECT src AS start, dst AS node, 1 AS length FROM e UNION SELECT start, dst, length + 1 FROM c JOIN e ON src = node WHERE length < 50) SELECT start AS node, min(length) AS length FROM c WHERE start = node GROUP BY start")
def circular_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(60))
    return graph.cyclic(table(spark, d, "part").select(k.alias("src"), F.pmod(k * 7, F.lit(60)).alias("dst")).distinct())


@query(
    f"WITH RECURSIVE e AS ({_DAG}), n AS (SELECT p_partkey AS node, 0.5 + (p_partkey * 37 % 50) / 100 AS c, p_partkey <= 1 AS ends FROM part), p AS (SELECT node, [node] AS path, c AS product, node AS at, ends, 0 AS depth FROM n UNION ALL SELECT p.node, list_append(path, n.node), product * n.c, n.node, n.ends, depth + 1 FROM p JOIN e ON e.src = p.at JOIN n ON n.node = e.dst WHERE NOT list_contains(path, n.node) AND depth < 5) "
    "SELECT n.node, round(coalesce(avg(product) FILTER (p.ends), any_value(c)), 6) AS trust, count(*) FILTER (p.ends) AS n_paths FROM n LEFT JOIN p USING (node) GROUP BY n.node"
)
def trust_scores(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (0.5 + F.pmod(F.col("p_partkey") * 37, F.lit(50)) / 100).alias("credibility"))
    return graph.trust(_dag(spark, d), nodes, F.col("node") <= 1, 5).withColumn("trust", F.round("trust", 6))


@query(f"WITH RECURSIVE e AS ({_DAG}), up AS (SELECT 37::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM up JOIN e ON src = node WHERE level < 20), down AS (SELECT 37::BIGINT AS node, 0 AS level UNION SELECT src, level + 1 FROM down JOIN e ON dst = node WHERE level < 20) SELECT 'ancestor' AS kind, node, min(level) AS level FROM up WHERE level > 0 GROUP BY node UNION ALL SELECT 'descendant', node, min(level) FROM down WHERE level > 0 GROUP BY node")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors and descendants of one node, with how many steps away they are."""
    e, start = _dag(spark, d), spark.range(37, 38).select(F.col("id").alias("node"))
    side = lambda edges, kind: graph.reach(edges, start, 20).filter("level > 0").select(F.lit(kind).alias("kind"), "node", "level")
    return side(e, "ancestor").unionByName(side(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "descendant"))


@query(f"WITH e AS ({_EDGES}), g AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node) SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, count(*) FILTER (o + i = 1) AS weak, count(*) FILTER (i > 30) AS hubs, max(i)::BIGINT AS most_cited, round(avg(o + i), 6) AS mean_degree, max(i) > 10 * avg(o + i) AS concentrated FROM g")
def network_risks(spark: SparkSession, d: str) -> DataFrame:
    """Counts of nodes, edges, weakly linked nodes and hubs, and whether one node holds too much."""
    g = graph.degrees(_edges(spark, d)).withColumn("n", F.col("n_out") + F.col("n_in"))
    return g.agg(
        F.count("*").alias("nodes"), F.sum("n_out").alias("edges"), F.count_if(F.col("n") == 1).alias("weak"), F.count_if(F.col("n_in") > 30).alias("hubs"), F.max("n_in").alias("most_cited"),
        F.round(F.avg("n"), 6).alias("mean_degree"), (F.max("n_in") > 10 * F.avg("n")).alias("concentrated"),
    )


@query("SELECT DISTINCT l_suppkey AS node, l_partkey AS other FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 3 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey = 3")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of node 3 over edges of one kind, either way."""
    e = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    out, back = e.filter("l_suppkey = 3").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("other")), e.filter("l_partkey = 3").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("other"))
    return out.unionByName(back).distinct()


@query("SELECT p_type AS label, count(*) AS n, round(0.6 * avg(p_size / 50) + 0.2 * least(count(DISTINCT p_brand) / 10, 1) + 0.2 * max((p_name LIKE '%ring%')::INT), 6) AS strength FROM part GROUP BY p_type")
def foundation_strength(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by label, with how firm they are as a basis: authority, variety, and whether a law is among them."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("label")).agg(
        F.count("*").alias("n"), F.round(0.6 * F.avg(F.col("p_size") / 50) + 0.2 * F.least(F.count_distinct("p_brand") / 10, F.lit(1.0)) + 0.2 * F.max(F.col("p_name").like("%ring%").cast("int")), 6).alias("strength")
    )
