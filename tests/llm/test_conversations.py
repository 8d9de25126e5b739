import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import convrepair, convtrie, queries, quality

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def ordered(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items() if c is not None}


def plain_trie(paths):
    nodes, kids = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p] + [q for k in kids.get(p, []) for q in below(k)]

    out = []
    for p, m in nodes.items():
        sub, ends = below(p), sorted(c for c in m if len(paths[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(WORD, q[-1][1])) for q in sub if q)
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), sum(not kids.get(q) for q in sub), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def odd_conversations():
    rnd, rows = random.Random(1), []
    for c in range(-5, 60):
        for t in range(rnd.choice([1, 2, 3, 4, 5, 9])):
            rows.append((c, rnd.choice([t, None, 1]) if c % 7 == 0 else t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "", "c d e", None])))
    rows += [(None, 1, "user", "x"), (7, 3, "user", "a b"), (7, 3, "user", "a b")]
    return rows + [(c, i, "user", f"t{i % 3}") for c in (200, 201) for i in range(40)]


@pytest.mark.parametrize("block", [7, 4096])
def test_trie_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(convtrie, "BLOCK", block)
    rows = odd_conversations()
    own = ordered(rows)
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    rebuilt = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: head[c]] + v[head[c] :]) for c, v in own.items()}
    turns = convtrie.numbered(frame(spark, rows).withColumn("owner", F.lit(1)))
    for paths, want in ((convtrie.shared_heads(turns), rebuilt), (convtrie.plain_paths(turns), {c: tuple(v) for c, v in own.items()})):
        assert sorted(tuple(r[c] for c in COLUMNS) for r in convtrie.trie(paths).collect()) == plain_trie(want)


def test_trie_of_no_rows_and_turnless_conversations(spark):
    assert convtrie.trie(convtrie.shared_heads(convtrie.numbered(frame(spark, [], 1)))).count() == 0
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4)
    got = convtrie.trie(convtrie.shared_heads(convtrie.numbered(frame(spark, [(c, 0, "user", "a")], 1)))).collect()
    assert [tuple(r[k] for k in COLUMNS) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_query_and_sql_agree(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
    rel = con.sql(queries.oracle_sql()["op11_prefix_trie"])
    got = queries.op11_prefix_trie(spark, f"/root/testdata/{sf}").select(*rel.columns).collect()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))
    assert order(got) == order(rel.fetchall())


def faults_of(rows):
    """(initial, must go, extra cost, fault) of rows (role, text)."""
    seen, out = set(), []
    for r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        fault = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((r[:1], fault in ("blank", "duplicate"), 3 * (fault == "truncated"), fault))
    return out


def least_repair(rows):
    """The cheapest (cost, audit, lines) by trying all edits."""
    info, best = faults_of(rows), None
    fits = lambda s: (s[1:] if s[:1] == "s" else s) == ("ua" * len(s))[: len(s[1:] if s[:1] == "s" else s)]
    whole = lambda s: s == "" or fits(s) and s[-1] == "a"

    def go(i, roles, cost, audit, lines):
        nonlocal best
        if cost > 4 * len(rows) or best and cost > best[0] or not fits(roles):
            return
        if i == len(rows) and whole(roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, lines
        for name in ("user", "assistant"):
            go(i, roles + name[0], cost + 3, audit + "I", [*lines, f"{name}:"])
        if i < len(rows):
            (role, text), (initial, must_go, extra, _) = rows[i], info[i]
            go(i + 1, roles, cost + 4, audit + "D", lines)
            if not must_go:
                if initial in ("u", "a") or initial == "s" and not roles:
                    go(i + 1, roles + initial, cost + extra, audit + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    go(i + 1, roles + name[0], cost + 3 + extra, audit + "R", [*lines, f"{name}:{text}"])

    go(0, "", 0, "", [])
    return best


def test_least_repairs_against_all_edits(spark):
    rnd, rows = random.Random(5), []
    for c in [None, *range(400)]:
        for t in range(rnd.randint(1, 5)):
            rows.append((c, rnd.choice([t, t, t, 2 * t, None]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rnd.choice(["A.", "B.", "C", "", " \n", "D! ", "E?", None])))
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    df = frame(spark, rows).withColumn("audit", F.lit("other"))
    turns = {}
    for r in sorted(convrepair.repaired_turns(df).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    got = convrepair.repair(df).collect()
    assert len(got) == len(convs) == 401
    for r in got:
        held = sorted(convs[r.conv_id])
        cost, audit, lines = least_repair([x[2:] for x in held])
        assert (r.cost, r.audit) == (cost, audit) and turns.get(r.conv_id, []) == lines
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        faults = [f[3] for f in faults_of([x[2:] for x in held])]
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        numbers = sorted({x[1] for x in held if x[0]})
        assert r.gaps == (numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0)
        roles = [x[2][:1] for x in held]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def test_repair_keeps_no_texts_and_drops_hopeless_items():
    for roles in (["user"], ["assistant"], ["system"], ["user", "user", "assistant"]):
        s = convrepair.Repair()
        for i in range(3000):
            s.take(i, roles[i % len(roles)], f"{i}.")
            assert len(s.column) <= 4 and not s.waiting
        s.end()
        assert len("".join(s.audit)) >= 3000


def test_repair_of_no_rows_and_of_conversations_that_are_gone(spark):
    assert convrepair.repair(frame(spark, [], 1)).count() == 0
    r = convrepair.repair(frame(spark, [(1, 0, "user", "x")], 1), gone=F.lit(True)).first()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = {}
    for r in queries.damaged(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [(role, "", True)], 1: [(role, "", False)], 2: [(role, re.sub("[.!?]", "", text), False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert got[c, t] == want.get(lot, [(role, text, False)])
    sf = "/root/testdata/sf0.001"
    ids = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r.conv_id for r in queries.op13_structure_repair(spark, sf).collect()} == ids


def plain_counts(text):
    text = text or ""
    words, windows, lines, again = re.findall(WORD, text), {}, set(), 0
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_counts_of_quality_rules(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "b", "é ", " ", "\n", "\n", "a b", "#", "\x0b", "A", "日"]) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [None, "", "\n\n", "a b c d e f g h " * 40_000, "x" * 700_000, "a b c d e f g h a b c d e f g h", "A\na\nA\n A"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("n_words", F.lit("other"))
    for r in quality.judge(df, quality.Model(quality.np.zeros(quality.SPACE), shift=35.0)).collect():
        want = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    held = queries.remainder("doc_id", 5) == 0
    model = quality.train(docs, labels.filter(~held))
    some = docs.join(labels.filter(held), "doc_id", "left_semi")
    rows = quality.judge(some, model).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 40
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)
    # calibrated: scores add up to about the number of good texts
    assert abs(sum(r.score for r in rows) - len(good)) < 0.05 * len(rows)


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "good words " * 30), (2, None), (1, "good words " * 30)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 7), (2, 1)], "doc_id long, quality int")
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for labels in (empty, odd, both):
        got = quality.judge(docs, quality.train(docs, labels)).collect()
        assert len(got) == 3 and all(r.base_failed for r in got if r.doc_id == 2) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.judge(docs.limit(0), quality.train(docs.limit(0), both)).count() == 0
