"""Limits by key: plain loops, long keys, streams that go on."""

import datetime as dt
import random

import pytest

from corpusmill.operators import folds
from corpusmill.streaming import alerts, limits

START = dt.datetime(2024, 1, 1)


def plain(rows, most, seconds, fixed):
    held, out = {}, {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        old = held.get(k, [])
        old = ([] if old and (t - old[0]).total_seconds() >= seconds else old) if fixed else [x for x in old if (t - x).total_seconds() < seconds]
        out[i] = len(old) < most
        held[k] = old + [t] if out[i] else old
    return out | {i: None for i, _, t in rows if t is None}


def events(n=400):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", "c", None]), START + dt.timedelta(seconds=rnd.randrange(20_000))) for i in range(n)]
    return rows + [(n + i, "steady", START + dt.timedelta(seconds=100 * i)) for i in range(150)] + [(9000, "a", None), (9001, "a", START), (9002, "a", START)]


@pytest.mark.parametrize("most,seconds,fixed", [(1, 300, False), (4, 900, False), (4, 900, True), (1, 50, True)])
def test_limits_against_a_plain_loop(spark, most, seconds, fixed):
    rows = events()
    df = spark.createDataFrame([(*r, False) for r in rows], "event_id long, k string, ts timestamp, allowed boolean").repartition(3)
    rule = folds.Calls if fixed else folds.Rate
    got = folds.decided(df, ["k"], "ts", "event_id", lambda: rule(most, seconds * 1_000_000))
    assert got.columns == ["event_id", "k", "ts", "allowed"]
    said = {r.event_id: r.allowed for r in got.collect()}
    assert said == plain([(i, k, t) for i, k, t in rows], most, seconds, fixed)
    assert folds.decided(df.limit(0), ["k"], "ts", "event_id", lambda: rule(1, 1)).count() == 0
    # a steady stream over the limit gets through as often as the limit allows
    steady = [said[i] for i, k, _ in rows if k == "steady"]
    assert sum(steady) > 20 and (all(steady) or not all(steady))


def test_memory_is_the_period_alone():
    rule = folds.Rate(5, 1_000)
    for i in range(100_000):
        rule.take(i)
    assert len(rule.memory) <= 5


def test_a_stream_goes_on_with_its_state(spark, tmp_path):
    rows = [(i, f"k{i % 7}", START + dt.timedelta(seconds=13 * i)) for i in range(900)]
    want = plain(rows, 3, 600, False)
    schema = "event_id long, k string, ts timestamp"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    before = spark.conf.get(limits.PROVIDER[0], None)
    try:
        for part in (rows[:300], rows[300:310], rows[310:]):
            spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(folder)
            stream = limits.decided(alerts.events(spark, folder, spark.read.parquet(folder).schema), ["k"], "ts", "event_id", lambda held: folds.Rate(3, 600_000_000, held))
            alerts.run_once(stream, out, check)
    finally:
        spark.conf.unset(limits.PROVIDER[0]) if before is None else spark.conf.set(limits.PROVIDER[0], before)
    got = spark.read.parquet(out).collect()
    assert len(got) == 900 and {r.event_id: r.allowed for r in got} == want and not all(want.values())
