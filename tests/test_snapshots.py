"""Snapshots restored at every version, against plain dictionaries."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import snapshots


def test_every_version_comes_back(spark):
    rnd, states = random.Random(2), {}
    for k in range(6):
        state = {}
        for v in sorted(rnd.sample(range(100), 17)):
            for p in "abcdef":
                if rnd.random() < 0.3:
                    state[p] = rnd.choice(["1", "2", None])
                elif rnd.random() < 0.2:
                    state.pop(p, None)
            if state:
                states[k, v] = dict(state)
    rows = [(k, v, p, x) for (k, v), s in states.items() for p, x in s.items()] + [(None, 1, "a", "1"), (1, None, "a", "1"), (1, 2, None, "1")]
    df = spark.createDataFrame(rows, "k long, v long, path string, value string").repartition(3).withColumn("gone", F.lit("other"))
    stored = snapshots.deltas(df, "k", "v", 4).persist()
    assert stored.count() < len(rows) and {r.full for r in stored.collect()} == {True, False}
    got = {}
    for r in snapshots.restore(stored, df.filter("k is not null and v is not null and path is not null"), "k", "v").collect():
        got.setdefault((r.k, r.v), {})[r.path] = r.value
    assert got == states
    assert snapshots.restore(stored, df.limit(0), "k", "v").count() == 0
    versions = sorted(v for k, v in states if k == 0)
    one = lambda v: df.filter(f"k = 0 and v = {v}").select("k", "path", "value")
    a, b = states[0, versions[0]], states[0, versions[-1]]
    want = {(p, a.get(p), b.get(p)) for p in a.keys() | b.keys() if (p in a) != (p in b) or a.get(p) != b.get(p)}
    found = snapshots.compare(one(versions[0]), one(versions[-1]), "k").collect()
    assert {(r.path, r.old, r.new) for r in found} == want and all(abs(r.likeness - max(0, 1 - len(want) / len(a))) < 1e-9 for r in found)


def test_paths_of_nested_values(spark):
    df = spark.sql("select 1 k, named_struct('a', 1, 'b', named_struct('c', cast(null as string), 'd', array(1, 2))) s union all select 2, null")
    assert sorted((r.k, r.path, r.value) for r in snapshots.paths(df, ["k"], "s").collect()) == [(1, "a", "1"), (1, "b.c", None), (1, "b.d", "[1,2]")]


def test_a_task_holds_some_of_the_keys_only(spark):
    """Told a number of parts, keys are dealt over them, once; versions of a key don't meet each other, only what holds at them."""
    df = spark.range(400).selectExpr("id % 40 as k", "id div 40 as v", "'a' as path", "cast(id div 80 as string) as value")
    states = df.unionByName(df.filter("v % 3 <> 0").selectExpr("k", "v", "'b' as path", "cast(null as string) as value"))
    stored = snapshots.deltas(states, "k", "v", 4, 13)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(k" in plan and ", 13)" in plan and "Join" not in plan
    back = snapshots.restore(stored, states.select("k", "v"), "k", "v", 13)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, states.collect()), key=str)
    between = spark.createDataFrame([(1, 3), (1, -1), (1, 99), (None, 2)], "k long, v long")
    got = {(r.k, r.v, r.path, r.value) for r in snapshots.restore(stored, between, "k", "v").collect()}
    assert got == {(1, 3, "a", "1"), (1, 99, "a", "4")}
