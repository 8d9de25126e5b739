"""Differences, patches and matched articles against difflib and plain loops."""

import hashlib
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import differences as D
from corpusmill.functions.matching import Held, common, matching_blocks, places, shared
from corpusmill.operators import versions
from corpusmill.plans import versions as plans

SF = "/root/testdata/sf0.001"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def pairs():
    rnd, out = random.Random(4), [("", ""), ("", "a\nb"), ("a", ""), ("a\n\nb", "a\nb\n"), ("é" * 300 + "x", "é" * 299 + "yx"), ("ab\n" * 500, "ab\n" * 400 + "c\n" + "ab\n" * 99)]
    for n in (3, 12, 60):
        for _ in range(60):
            old = [rnd.choice(["a", "b", "c", "", "dd e"]) for _ in range(rnd.randint(1, n))]
            new = [x for x in old if rnd.random() > 0.2] + [rnd.choice("abz") for _ in range(rnd.randint(0, 3))]
            out.append(("\n".join(old), "\n".join(new)))
    return out


def test_edits_and_patches_of_odd_pairs(spark):
    given = pairs() + [(None, "a"), ("a", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(given)], "i int, a string, b string").repartition(3)
    patch = D.hunks(F.col("a"), F.col("b"))
    rows = df.withColumn("patch", patch).select("*", D.similarity(F.col("a"), F.col("b")).alias("ratio"), D.edits(F.col("a"), F.col("b")).alias("edits"), D.patched(F.col("a"), F.col("patch")).alias("there"))
    rows = rows.withColumn("back", D.patched(F.col("there.text"), D.reverse(F.col("patch")))).collect()
    assert len(rows) == len(given)
    for r in rows:
        if r.a is None or r.b is None:
            assert r.ratio is r.edits is r.patch is r.there is r.back is None
            continue
        m = SequenceMatcher(None, r.a, r.b)
        assert r.ratio == m.ratio() and [tuple(e) for e in r.edits] == [(op, r.a[i:j], r.b[k:n]) for op, i, j, k, n in m.get_opcodes() if op != "equal"]
        assert r.there.text == r.b and r.back.text == r.a and not r.there.conflicts and not r.back.conflicts


def test_conflicts_are_named_and_left_out(spark):
    patch = D.hunks(F.lit("a\nb\nc\nd"), F.lit("a\nB\nc\nD\ne"))
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nx\nc\nd"), (3, "a\nb"), (4, "")], "i int, t string").withColumn("r", D.patched(F.col("t"), patch))
    got = {r.i: (r.r.text, r.r.conflicts) for r in df.collect()}
    assert got == {1: ("a\nB\nc\nD\ne", []), 2: ("a\nx\nc\nD\ne", ["hunk 0: other lines at 1"]), 3: ("a\nB", ["hunk 1: no lines 3 to 4"]), 4: ("", ["hunk 0: no lines 1 to 2", "hunk 1: no lines 3 to 4"])}
    said = df.select(D.unified(D.hunks(F.lit("a\nb"), F.lit("a\nc\nd")))).first()[0]
    assert said == "@@ -2,1 +2,2 @@\n-b\n+c\n+d"


def test_hunks_and_changes_of_documents(spark):
    both = {r.doc_id: (r.old, r.new) for r in plans._both(spark, SF).collect()}
    want, changes = set(), {}
    for i, (a, b) in both.items():
        old, new = a.split("\n"), b.split("\n")
        steps = [o for o in SequenceMatcher(None, old, new).get_opcodes() if o[0] != "equal"]
        for n, (op, s, e, k, m) in enumerate(steps):
            want.add((i, n, {"insert": "ADD", "delete": "DELETE", "replace": "REPLACE"}[op], s, e - s, k, m - k, md5("\n".join(old[s:e])), md5("\n".join(new[k:m]))))
        m = SequenceMatcher(None, a, b)
        edits = [(op, a[s:e], b[k:n]) for op, s, e, k, n in m.get_opcodes() if op != "equal"]
        changes[i] = (round(m.ratio(), 9), *(sum(e[0] == op for e in edits) for op in ("replace", "delete", "insert")), md5("\n".join("|".join(e) for e in edits)))
    assert {tuple(r) for r in catalogue.queries()["patch_hunks"](spark, SF).collect()} == want and len(want) > 100
    assert {r.doc_id: tuple(r)[1:] for r in catalogue.queries()["text_changes"](spark, SF).collect()} == changes


def plain_matches(old, new, least):
    """One document: old and new are {number: content}."""
    out = [(n, n, "number", None) for n in old if n in new]
    a, b = {n: c for n, c in old.items() if n not in new}, {n: c for n, c in new.items() if n not in old}
    for c in set(a.values()):
        for x, y in zip(sorted(n for n in a if a[n] == c), sorted(n for n in b if b[n] == c)):
            out.append((x, y, "content", 1.0))
    a, b = {n: c for n, c in a.items() if n not in {o[0] for o in out}}, {n: c for n, c in b.items() if n not in {o[1] for o in out}}
    kind = lambda n: next((p for p in versions.PREFIXES if p in n), "plain")
    scored = []
    for x in a:
        for y in b:
            ratio = 1.0 if a[x].lower() == b[y].lower() else SequenceMatcher(None, a[x].lower(), b[y].lower()).ratio()
            likeness = min(1.0, ratio + 0.1 * (kind(x) == kind(y)))
            if likeness >= least:
                scored.append((-likeness, -ratio, x, y))
    for likeness, _, x, y in sorted(scored):
        if x in a and y in b:
            out.append((x, y, "likeness", round(-likeness, 9)))
            del a[x], b[y]
    return out


def test_articles_against_a_plain_greedy_loop(spark, monkeypatch):
    monkeypatch.setattr(versions, "run_keys", lambda c, most=8: F.array(F.lit(1)))  # every pair of a document meets
    rnd, old, new = random.Random(8), {}, {}
    words = "law of the sea and land act code rule one two three".split()
    for d in range(12):
        old[d] = {f"{'Ek Madde ' if n % 5 == 0 else ''}{n}": " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for n in range(8)}
        new[d] = {}
        for n, c in old[d].items():
            lot = rnd.random()
            if lot < 0.3:
                new[d][n] = c
            elif lot < 0.9:
                new[d]["9" + n] = c if lot < 0.5 else c.upper() if lot < 0.6 else c + " more"
    frame = lambda v: spark.createDataFrame([(d, n, None, c) for d in v for n, c in v[d].items()] + [(None, "1", "t", "x"), (3, None, "t", "x")], "doc_id int, number string, title string, content string").repartition(3).withColumn("h", F.lit("other"))
    got = sorted((r.doc_id, r.old_number, r.new_number, r.how, None if r.likeness is None else round(r.likeness, 9)) for r in versions.match_articles(frame(old), frame(new), "doc_id").collect())
    assert got == sorted((d, *m) for d in old for m in plain_matches(old[d], new[d], versions.LEAST)) and {g[3] for g in got} == {"number", "content", "likeness"}
    assert versions.match_articles(frame({}).limit(0), frame(new), "doc_id").count() == 0


def test_articles_of_documents(spark):
    frames = plans.articles(spark, SF)
    old, new = ({}, {})
    for df, into in zip(frames, (old, new)):
        for r in df.collect():
            into.setdefault(r.doc_id, {})[r.number] = r.content
    got = {}
    for r in catalogue.queries()["article_matches"](spark, SF).collect():
        got.setdefault(r.doc_id, set()).add((r.old_number, r.new_number, r.how))
    some = [d for d in sorted(old) if len(old[d]) < 25]
    want = {d: {m[:3] for m in plain_matches(old[d], new.get(d, {}), versions.LEAST)} for d in some}
    renumbered = sum(len([m for m in want[d] if m[2] == "likeness"]) for d in some)
    same = sum(len(want[d] & got.get(d, set())) for d in some)
    # by number and content alike; by likeness all but pairs that share no run of three words
    assert same >= 0.97 * sum(map(len, want.values())) and renumbered > 30
    assert all({m for m in want[d] if m[2] != "likeness"} == {m for m in got.get(d, set()) if m[2] != "likeness"} for d in some)


def test_equal_articles_take_no_rounds(spark):
    """Pairs that are all alike: one is taken after another, in a few jobs however many there are."""
    near = [(d, f"{x:02}", f"n{y:02}", 0.9, 0.8) for d in (1, 2) for x in range(40) for y in range(30)] + [(3, "a", "b", 0.7, 0.6), (3, "a", "c", 0.7, 0.65), (3, "d", "c", 0.9, 0.8)]
    pairs = spark.createDataFrame(near, "doc int, old_ string, new_ string, likeness double, ratio double").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("equal-articles", "greedy")
    got = {tuple(r)[:3] for r in versions.greedy(pairs, "doc").collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("equal-articles"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(d, f"{x:02}", f"n{x:02}") for d in (1, 2) for x in range(30)} | {(3, "a", "b"), (3, "d", "c")}
    assert 0 < jobs < 10


def test_keys_split_a_text_once(spark):
    """A line of 20,000 words, whose words were found again for each of its runs."""
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),)], "x string").repartition(1)
    began = time.monotonic()
    keys = df.select(versions.run_keys(F.col("x")).alias("k")).first().k
    assert len(keys) == versions.KEYS and keys == sorted(keys) and time.monotonic() - began < 20


def test_all_alike_articles_are_found(spark, monkeypatch):
    """Pairs that share no run of three words, or none of the least-hashed ones; the loop over all pairs is the measure. Small parts, so documents have several tiles."""
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in "ktm" for b in "aeo" for c in "nrs"]
    old, new = {1: {"1": "alpha beta gamma delta", "2": "İİİİ", "3": "abcde", "4": "kmpq", "5": "x"}, 2: {}}, {1: {"n1": "alpha bets gamma delta", "n2": "İİİİ".lower() + "z" * 10, "n3": "abc", "n4": "kmrs", "n5": "xyzz"}, 2: {}}
    for n in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(1, 90))]
        old[2][f"{'Ek Madde ' if n % 7 == 0 else ''}{n:02}"] = " ".join(text)
        # a letter more in every other word: no run of three words is left
        new[2][f"{'Ek Madde ' if n % 5 == 0 else ''}n{n:02}"] = " ".join(w + "l" * (i % 2) for i, w in enumerate(text) if rnd.random() < 0.9)
    frame = lambda v: spark.createDataFrame([(d, n, None, c) for d in v for n, c in v[d].items()], "doc_id int, number string, title string, content string").repartition(3)
    want = sorted((d, *m) for d in old for m in plain_matches(old[d], new[d], versions.LEAST))
    for part in (versions.TILE, 9):
        monkeypatch.setattr(versions, "TILE", part)
        got = sorted((r.doc_id, r.old_number, r.new_number, r.how, round(r.likeness, 9)) for r in versions.match_articles(frame(old), frame(new), "doc_id").collect())
        assert got == want and len([g for g in got if g[3] == "likeness"]) > 20
        assert {(1, "1", "n1", "likeness", 1.0), (1, "2", "n2", "likeness", 0.715384615), (1, "4", "n4", "likeness", 0.6)} <= set(got)


def test_articles_of_documents_are_all_matched(spark):
    frames = plans.articles(spark, SF)
    old, new = ({}, {})
    for df, into in zip(frames, (old, new)):
        for r in df.collect():
            into.setdefault(r.doc_id, {})[r.number] = r.content
    got = {}
    for r in catalogue.queries()["article_matches"](spark, SF).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert got == {d: w for d in old if (w := set(plain_matches(old[d], new.get(d, {}), versions.LEAST)))}


def test_subsequences_bound_blocks():
    for a, b in pairs():
        n = sum(size for _, _, size in matching_blocks(a, b))
        longest = [0] * (len(b) + 1)
        for c in a:
            row = [0]
            for j, e in enumerate(b):
                row.append(longest[j] + 1 if c == e else max(longest[j + 1], row[j]))
            longest = row
        assert n <= common(places(a), len(a), b) == longest[-1]
        assert shared(a, Held(b), n) == n and shared(a, Held(b), n + 1) == (n if a == b else None)
