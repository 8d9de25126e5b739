"""Recursive chunks and clause trees against plain recursions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import recursive
from corpusmill.operators import clauses
from corpusmill.plans import texts

SF = "/root/testdata/sf0.001"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain_chunks(text, depth, most, target, levels):
    """Sizes and depths, by recursion over strings."""
    if len(text) <= most:
        return [(len(text), depth)]
    if depth < levels and text.strip():
        for s in recursive.SEPARATORS:
            pieces, rest = [], text
            blank = len(text) - len(text.lstrip())
            at = [m.start() for m in re.finditer(s, text, re.M | re.I) if m.start() > blank]
            for a, b in zip([0, *at], [*at, len(text)]):
                pieces.append(text[a:b])
            if len(pieces) > 1:
                found = [c for p in pieces for c in plain_chunks(p, depth + 1, most, target, levels)]
                out = []
                for n, d in found:
                    if out and out[-1][0] + n <= most:
                        out[-1] = (out[-1][0] + n, out[-1][1])
                    else:
                        out.append((n, d))
                return out
    return [(min(target, len(text) - i), depth) for i in range(0, len(text), target)]


@pytest.mark.parametrize("most,target,levels", [(40, 20, 7), (25, 25, 2), (1024, 512, 7), (9, 4, 0)])
def test_chunks_against_a_plain_recursion(spark, most, target, levels):
    rnd = random.Random(most)
    bits = ["a", "bb ", "long word. ", "\n\n", "\n", "\nMADDE 3 ", "\n BÖLÜM", "x" * 60, "  ", ". ", "é日"]
    given = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(120)] + [None, "", " \n ", " " * 3000 + "a", "x" * 70_000, "word " * 20_000, "\n\nA" * 3000]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3).withColumn("part", F.lit("other"))
    got = {}
    for r in sorted(recursive.chunks(df, most=most, target=target, levels=levels).collect(), key=lambda r: r.chunk):
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(given):
        rows = got.get(i, [])
        assert bool(rows) == bool((t or "").strip())
        if rows:
            assert [(r.stop - r.start, r.depth) for r in rows] == plain_chunks(t, 0, most, target, levels)
            assert "".join(r.part for r in rows) == t and max(len(r.part) for r in rows) <= most
            assert all(t[r.start : r.stop] == r.part for r in rows) and [r.after for r in rows] == [n.part[:50] for n in rows[1:]] + [""]
    with pytest.raises(ValueError):
        recursive.chunks(df, most=5, target=6)


def test_chunks_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in sorted(catalogue.queries()["recursive_chunks"](spark, SF).collect(), key=lambda r: r.chunk):
        got.setdefault(r.doc_id, []).append(r)
    for i, rows in got.items():
        assert [(r.stop - r.start, r.depth) for r in rows] == plain_chunks(docs[i], 0, 1024, 512, 7)
        assert rows[0].start == 0 and rows[-1].stop == len(docs[i]) and all(a.stop == b.start for a, b in zip(rows, rows[1:]))
        assert all(r.part_md5 == md5(docs[i][r.start : r.stop]) for r in rows)


ARTICLE = """Şirket yönetimi.
(1) Şirket, kurul tarafından yönetilir.
(2) Görevleri şunlardır:
a) Kararları uygulamak,
b) İşleri yürütmek,
    i) Bütçe hazırlamak,
    ii) Personel almak.
b) Yine işler:
1) bir
2) iki"""


def test_a_nested_article(spark):
    df = spark.createDataFrame([(1, 5, ARTICLE), (2, 6, ""), (3, 7, None), (4, None, "x"), (5, 8, "a) one\nb) two")], "doc_id long, number int, content string")
    rows = {(r.doc_id, r.path): r for r in clauses.clause_tree(df.withColumn("path", F.lit("other"))).collect()}
    want = "M.5 M.5/F.1 M.5/F.2 M.5/F.3 M.5/F.3/B.a M.5/F.3/B.b M.5/F.3/B.b/AB.i M.5/F.3/B.b/AB.ii M.5/F.3/B.b-2 M.5/F.3/B.b-2/AB.1 M.5/F.3/B.b-2/AB.2".split()
    assert sorted(p for d, p in rows if d == 1) == sorted(want)
    at = lambda p: rows[1, p]
    assert at("M.5/F.1").content == "Şirket yönetimi." and at("M.5/F.3").content == "" and at("M.5/F.3").lead == "Görevleri şunlardır:"
    assert at("M.5/F.3/B.b").lead == "İşleri yürütmek," and at("M.5/F.3/B.b/AB.ii").content == "Personel almak." and at("M.5/F.3/B.b-2/AB.2").lead == "iki"
    assert all(r.parent_path == (r.path.rpartition("/")[0] or None) for r in rows.values())
    assert {p for d, p in rows if d == 2} == {"M.6", "M.6/F.1"} and rows[2, "M.6/F.1"].content == "" and not any(d in (3, 4) for d, _ in rows)
    # leads in the order of the tree are the text, but for marks and white space
    said = lambda x: re.sub(r"\s+", "", x)
    marks = re.sub(r"\(\d+\)|^[ \t]*(?:[a-zçğı]|[ivx]+|\d+)\)", "", ARTICLE, flags=re.M)
    assert said("".join(at(p).lead for p in want)) == said(marks)
    assert [rows[5, p].content for p in ("M.8/F.1/B.a", "M.8/F.1/B.b")] == ["one", "two"]


def plain_tree(number, text):
    strip = lambda x: x.strip(" \t\n\v\f\r")
    out = [("article", str(number), 0, f"M.{number}", None, "")]

    def marked(x, mark, indent):
        return [(m[1], strip(m[2])) for m in re.finditer(rf"^{indent}({mark})\)[ \t\n\v\f\r]+(.+?)(?=\n{indent}(?:{mark})\)|\Z)", x, re.M | re.S)]

    def add(kind, short, level, parent, pieces, below):
        met = {}
        for n, x in pieces:
            met[n] = met.get(n, 0) + 1
            path = f"{parent}/{short}.{n}" + (f"-{met[n]}" if met[n] > 1 else "")
            out.append((kind, n, level, path, parent, below(path, x)))

    def subs(path, x):
        add("subclause", "AB", 3, path, marked(x, "(?i:[ivxlcdm]+)", r"[ \t]*") or marked(x, "[0-9]+", r"[ \t]*"), lambda p, y: y)
        return x

    def para(path, x):
        found = marked(x, clauses.CLAUSE, "")
        add("clause", "B", 2, path, found, subs)
        return "" if found else x

    parts = [strip(p) for p in re.split(r"\([0-9]+\)[ \t\n\v\f\r]*", text)]
    parts = [p for p in parts if p] or [""]
    add("paragraph", "F", 1, f"M.{number}", [(str(i + 1), p) for i, p in enumerate(parts)], para)
    return out


def test_trees_of_documents(spark):
    given = texts._articles(spark, SF).collect()
    want = {(r.doc_id, *t[:5], md5(t[5])) for r in given for t in plain_tree(r.number, r.content)}
    rows = catalogue.queries()["clause_trees"](spark, SF).collect()
    assert {(r.doc_id, r.kind, r.number, r.level, r.path, r.parent_path, r.content_md5) for r in rows} == want and len(rows) == len(want)
    assert {r.level for r in rows} == {0, 1, 2, 3}


def test_long_articles_take_linear_time(spark):
    df = spark.createDataFrame([(1, 1, "".join(f"(1) p\na) x{i}\n" for i in range(20_000)))], "doc_id long, number int, content string")
    assert clauses.clause_tree(df).groupBy("kind").count().collect().__len__() == 3
