import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import jaccard


def brute(rows, k, percent):
    sets, owner = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append(s)
        owner.append(i)
    root = {i: i for i in owner}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(owner[x]), find(owner[y])
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in zip(owner, sets))


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "beta", "Gamma", "delta", "é", "x1", "of", "the"]) + rnd.choice(["", "s", "a", "b", "c", "d"])
    bases = [[word() for _ in range(rnd.choice([1, 3, 7, 9, 12, 30, 80, 200]))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.choice([0, 1])] = [word()] * rnd.choice([0, 1])
        rows.append((i * 3, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("k,percent,tile,told,grid", [(4, 85, 1024, 10_000, 64), (4, 85, 4, 10_000, 64), (4, 85, 4, 0, 64), (4, 85, 4, 10_000, 1), (5, 80, 1024, 10_000, 64), (2, 80, 3, 10_000, 1)])
def test_against_brute_force(spark, monkeypatch, k, percent, tile, told, grid):
    monkeypatch.setattr(jaccard, "BROADCAST_CLUSTERS", told)
    monkeypatch.setattr(jaccard, "GRID_TILES", grid)
    rows = corpus(k * tile, 220)
    rows += [(1, None), (2, ""), (4, " \n"), (5, "one"), (7, "ONE"), (8, rows[3][1]), (10, rows[3][1].upper()), (rows[5][0], rows[5][1]), (rows[6][0], rows[9][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = jaccard.near_duplicates(docs, k=k, percent=percent, tile_sets=tile).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, percent)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (r.component_id for r in jaccard.near_duplicates(one).collect()))) == ["3", "None"]
    assert jaccard.one_of_each(one).count() == 2


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_keys_meet_for_every_pair_that_links(percent):
    rnd = np.random.default_rng(5)
    sketch = rnd.integers(0, 5, jaccard.SLOTS).astype(np.uint8)
    for _ in range(2000):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        drop, add = rnd.integers(0, max(1, n // 8) + 1, 2)
        b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 1 << 64, int(add), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
            assert np.intersect1d(jaccard.keys(a, sketch, percent), jaccard.keys(b, sketch, percent)).size


def test_shared_passages_make_no_groups(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(120)]
        at = rnd.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    led = jaccard.meetings(docs, 5, 80).groupBy("lead").count().collect()
    assert len(led) == 20 and max(r["count"] for r in led) == 1
    # a sketch that tells nothing apart: one large cluster, the same links
    monkeypatch.setattr(jaccard, "rarity", lambda *_: np.zeros(jaccard.SLOTS, np.uint8))
    monkeypatch.setattr(jaccard, "GRID_TILES", 2)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, tile_sets=64).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_large_groups_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[50:]])) for i in range(1, 400)] + [(i, " ".join(base)) for i in range(400, 900)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile_sets=32).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}


def test_sketch_counts_documents_of_all_tasks(spark):
    docs = spark.createDataFrame([(f"common words that all have here own{i}",) for i in range(40)] + [(None,), ("",)], "text string").repartition(4)
    sketch = jaccard.rarity(docs, 5)
    assert sorted(sketch[sketch > 0].tolist())[-1] == int(8 * np.log2(41))
    assert (sketch == 8).sum() == 40 and len(sketch) == jaccard.SLOTS
