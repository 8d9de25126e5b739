"""References and their antecedents against a plain scan."""

import re

from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import spans
from corpusmill.operators import references as R
from corpusmill.plans import texts

SF = "/root/testdata/sf0.001"


def plain(text):
    every = sorted((m.start(), -p.confidence, p.kind, m.end(), m[0]) for p in R.PATTERNS for m in re.finditer(p.pattern, text))
    named = {k: [(m.start(), m.end(), int(re.search("[0-9]+", m[0])[0])) for m in re.finditer(p, text)] for k, p in (("ARTICLE", R.ARTICLE), ("LAW", R.LAW))}
    out, last = [], 0
    for start, sure, way, end, found in every:
        if start < last:
            continue
        last = end
        kind = {"article": "ARTICLE", "law": "LAW"}.get(way) or next(k for w, k in R.KINDS.items() if found.endswith(w))
        some = []
        if way in ("article", "law"):
            some = [(start, int(re.search("[0-9]+", found)[0]))]
        elif way == "forward" and kind == "ARTICLE":
            some = [(s, n) for s, _, n in named["ARTICLE"] if s >= end][::-1]
        elif kind == "ARTICLE" or kind == "LAW" and way == "backward":
            some = [(s, n) for s, e, n in named[kind] if e <= start]
        target, distance = (some[-1][1], abs(some[-1][0] - start)) if some else (None, None)
        out.append((start, end, found, way, kind, target, distance, -sure, len(some)))
    return out


def test_references_of_documents(spark):
    given = {r.doc_id: r.text for r in texts._cited(spark, SF).collect()}
    want = {(i, *r) for i, t in given.items() for r in plain(t)}
    rows = catalogue.queries()["resolved_references"](spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert {r.direction for r in rows} == {"backward", "forward", "internal", "article", "law"}


def test_references_by_hand(spark):
    text = "5237 sayılı Türk Ceza Kanunu Madde 141 uyarınca. Anılan kanun; söz konusu kanun ve yukarıda belirtilen madde, aşağıdaki madde. Madde 7 bu madde, bu fıkra."
    df = spark.createDataFrame([(1, text), (2, None), (None, text), (3, ""), (4, "anılan madde")], "doc_id long, text string").withColumn("kind", F.lit("other"))
    got = {(r.doc_id, r.found): (r.direction, r.kind, r.target, r.candidates) for r in R.references(df).collect()}
    assert got == {
        (1, "5237 sayılı Türk Ceza Kanunu"): ("law", "LAW", 5237, 1), (1, "Madde 141"): ("article", "ARTICLE", 141, 1), (1, "söz konusu kanun"): ("backward", "LAW", 5237, 1), (1, "yukarıda belirtilen madde"): ("backward", "ARTICLE", 141, 1),
        (1, "aşağıdaki madde"): ("forward", "ARTICLE", 7, 1), (1, "Madde 7"): ("article", "ARTICLE", 7, 1), (1, "bu madde"): ("internal", "ARTICLE", 7, 2), (1, "bu fıkra"): ("internal", "PARAGRAPH", None, 0), (4, "anılan madde"): ("backward", "ARTICLE", None, 0),
    }


def test_a_text_is_gone_through_once(spark):
    df = spark.createDataFrame([(1, "Madde 5. Madde 99999999999999999999 ve anılan madde.")], "doc_id long, text string")
    made = R.references(df)
    got = {(r.found, r.target, r.candidates) for r in made.collect()}
    assert got == {("Madde 5", 5, 1), ("Madde 99999999999999999999", None, 1), ("anılan madde", None, 2)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    texts_ = ["madde madde 1 bu işbu madde", "işbu karar bu karar", "son aşağıda aşağıdaki madde", "12345 sayılı 1234 sayılı", ""]
    for p in R.PATTERNS:
        assert all([m.span() for m in spans.matches(t, p)] == [m.span() for m in re.finditer(p.pattern, t)] for t in texts_)
