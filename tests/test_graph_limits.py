"""Chains and cycles of more than fifty edges."""

from corpusmill.operators import graph


def test_chains_to_their_end_and_cycles_told(spark):
    n = 54
    edges = [(i, i + 1) for i in range(n)] + [(0, n), (5, 5), (3, 9), (200, 201), (201, 200), (202, 200), (None, 1)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(2)
    got = {r.node: r.depth for r in graph.chain_depths(df.filter("src is not null")).collect()}
    assert got == {i: n + 1 - i for i in range(n + 1)} | {200: None, 201: None, 202: None}
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(900, 0), (7, 901), (902, 902), (903, 904), (904, 903)], "src long, dst long").repartition(2)
    assert {r.node: r.length for r in graph.cyclic(ring).collect()} == {i: n for i in range(n)} | {902: 1, 903: 2, 904: 2}


def test_levels_send_nothing_through_the_driver(spark, monkeypatch):
    """Fronts and edges that are left grow with the graph: no level broadcasts them."""
    from corpusmill.operators import graph

    told, kept = [], graph.durable

    def seen(df):
        df.collect()
        told.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(graph, "durable", seen)
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 40)], "src long, dst long")
    back = edges.selectExpr("dst as src", "src as dst")
    starts = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.level for r in graph.reach(back, starts, 20).collect()} == {i: i.bit_length() for i in range(40)}
    assert {r.node: r.depth for r in graph.chain_depths(edges).collect()} == {i: i.bit_length() + 1 for i in range(40)}
    assert graph.paths(back, starts, 3).count() == 8
    assert len(told) > 10 and not any("BroadcastHashJoin" in x for x in told)


def test_edges_are_shuffled_once_for_all_levels(spark, monkeypatch):
    from corpusmill.operators import graph

    told, kept = [], graph.durable

    def seen(df):
        df.collect()
        told.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return kept(df)

    monkeypatch.setattr(graph, "durable", seen)
    monkeypatch.setattr(graph, "PART", 20)
    back = spark.createDataFrame([(i // 2, i) for i in range(1, 64)] * 2, "src long, dst long")
    paths = graph.paths(back, spark.createDataFrame([(1,)], "node long"), 4)
    assert {(r.node, r.level, r.before) for r in paths.collect()} == {(i, i.bit_length() - 1, i // 2 if i > 1 else None) for i in range(1, 32)}
    assert sum("hashpartitioning(src" in x for x in told) == 1 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
