"""Weights learnt from feedback against a plain loop."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import learning


def test_learning_against_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random(), rnd.random() * (0.2 if k == "b" else 1)) for k in ("a", "b", None) for i in range(257)]
    rows += [("short", i, 0.5, 0.5) for i in range(9)] + [("a", 1000, None, 0.1), ("a", None, 0.1, 0.1)]
    want = {}
    for k in ("a", "b", None):
        weights, seen = [w[0] for w in learning.WEIGHTS.values()], []
        for _, i, p, t in sorted((r for r in rows if r[0] == k and r[1] is not None and r[2] is not None), key=lambda r: r[1]):
            seen.append(p - t)
            if len(seen) % 10 == 0:
                last = seen[-100:]
                e = sum(last) / len(last)
                new = [max(low, min(high, w - e * 0.5 * share)) for w, (_, low, high, share) in zip(weights, learning.WEIGHTS.values())]
                weights = [w / sum(new) for w in new]
                want[k, len(seen) // 10] = (e, sum(x * x for x in last) / len(last), *weights)
    df = spark.createDataFrame(rows, "k string, i long, p double, t double").repartition(3).withColumn("version", F.lit("other"))
    got = {(r.k, r.version): (r.mean_error, r.mse, r.hallucination, r.rag_quality, r.reasoning) for r in learning.learned(df, "k", ["i"], "p", "t", rate=0.5).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    assert learning.learned(df.limit(0), "k", ["i"], "p", "t").count() == 0
