"""Logic of articles against loops over pairs and plain searches."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.operators import logic as L
from corpusmill.plans import logic as plans

SF = "/root/testdata/sf0.001"


def said(row):
    low = (row.content or "").lower()
    any_of = lambda words: any(w in low for w in words)
    term = re.search(L.TERM, low)
    return dict(
        at=(row.place, row.number), low=low, subject=next(iter(re.findall(r"[^\t-\r ]+", low)), None), obliges=any_of(L.OBLIGATION), forbids=any_of(L.PROHIBITION), conditional=any_of(L.CONDITION), concludes=any_of(L.CONSEQUENCE), exempts=any_of(L.EXEMPTION), scope=any_of(L.SCOPE), prior=any_of(L.PRIORITY),
        only={w for w in L.ONLY if w in low}, term=term and int(term[1]) * L.DAYS[term[2]], impossible="hem de" in low and any_of(L.NEGATION), refers=re.findall(L.REFERENCE, low),
    )


def plain(rows):
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(said(r))
    out = []
    for doc, arts in docs.items():
        arts.sort(key=lambda a: a["at"])
        add = lambda a, what, about, other, n: out.append((doc, *a["at"], what, about, other, n))
        scope = next((a for a in arts if a["scope"]), None)
        for a in arts:
            others = [b for b in arts if b is not a]
            same = [b for b in arts if b["subject"] and b["subject"] == a["subject"]]
            foes = [b for b in same if b["forbids"]]
            if a["obliges"] and foes:
                add(a, "contradiction", a["subject"], foes[0]["at"][1], len(foes))
            for name, part in (("exclusive_obligations", lambda b: b["obliges"]), ("exclusive", lambda b: not b["prior"])):
                foes = [b for b in others if part(b) and b["only"] & a["only"]]
                if part(a) and foes:
                    add(a, name, ",".join(w for w in L.ONLY if w in a["only"]), (foes[0] if foes[0]["at"] < a["at"] else foes[-1])["at"][1], len(foes))
            if a["conditional"] and not a["concludes"]:
                add(a, "incomplete_condition", None, None, 0)
            if a["conditional"] and a["impossible"]:
                add(a, "impossible_condition", None, None, 0)
            timed = sorted(((b["term"], *b["at"]) for b in same if b["obliges"] and b["term"] is not None))
            foes = [t for t in timed if t[0] != a["term"]]
            if a["obliges"] and a["term"] is not None and foes:
                add(a, "conflicting_terms", a["subject"], (timed[-1] if a["term"] == timed[0][0] else timed[0])[2], len(foes))
            words = list(dict.fromkeys(re.findall(L.EXEMPTED, a["low"]))) if a["exempts"] and scope else []
            words = [w for w in words if w not in scope["low"]]
            if words:
                add(a, "exceeding_exemption", ",".join(words), scope["at"][1], len(words))
            for date, side in dict.fromkeys(re.findall(L.DATED, a["low"])):
                foes = [b for b in same if (date, "sonra" if side == "önce" else "önce") in re.findall(L.DATED, b["low"])]
                if foes:
                    add(a, "before_and_after", f"{a['subject']} {date}", foes[0]["at"][1], len(foes))
    return sorted(out, key=str)


ALL = {"contradiction", "exclusive_obligations", "exclusive", "incomplete_condition", "impossible_condition", "conflicting_terms", "exceeding_exemption", "before_and_after"}


def test_findings_of_documents(spark):
    want = plain(plans.ruled_lines(spark, SF).collect())
    got = catalogue.queries()["logic_findings"](spark, SF)
    assert tuple(got.columns) == L.FINDING
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {w[3] for w in want} == ALL


def graph_of(rows, conditional):
    edges = defaultdict(set)
    for r in rows:
        a = said(r)
        if r.doc_id is not None and r.number is not None and (a["conditional"] or not conditional):
            edges[r.doc_id, r.number] |= {(r.doc_id, n) for n in a["refers"]}
    return edges


def distances(edges, start):
    """Steps to every node that can be come to, the start itself by a way of one step or more."""
    seen, front, n = {}, [start], 0
    while front:
        n += 1
        front = {b for a in front for b in edges.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(front, n)
    return seen


def test_circles_and_inherited_facts_of_documents(spark):
    rows = plans.ruled_lines(spark, SF).collect()
    edges = graph_of(rows, False)
    circles = {(*node, distances(edges, node)[node]) for node in edges if node in distances(edges, node)}
    got = catalogue.queries()["circular_articles"](spark, SF).collect()
    assert {tuple(r) for r in got} == circles and circles and len(got) == len(circles)

    edges, own = graph_of(rows, True), defaultdict(set)
    for r in rows:
        a = said(r)
        own[r.doc_id, r.number] |= {(a["subject"], sign) for sign, on in ((1, a["obliges"]), (-1, a["forbids"])) if on and a["subject"]}
    want = set()
    for node in list(own):
        near = {}
        for other, n in {**distances(edges, node), node: 0}.items():
            for fact in own.get(other, ()):
                near[fact] = min(n, near.get(fact, n))
        want |= {(*node, s, n, near[s, -1]) for (s, sign), n in near.items() if sign == 1 and (s, -1) in near and n + near[s, -1] > 0}
    got = catalogue.queries()["inherited_contradictions"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and want and len(got) == len(want)


def test_findings_by_hand(spark):
    rows = [
        (1, 0, "1", "Taşıyıcı 30 GÜN içinde bildirim yapmak zorundadır"), (1, 1, "2", "taşıyıcı 2 ay içinde uymak zorundadır, ama başkası kullanılamaz"), (1, 2, "3", "Sadece sadece"), (1, 3, "4", "bir sadece ve yalnızca"), (1, 4, "5", "iki yalnızca"),
        (1, 5, "6", "üç yalnızca öncelikle"), (2, 0, "1", "bu yasa kapsamı: gemi"), (2, 1, "2", "gemi hariç, uçak muaf"), (2, None, None, None), (None, 0, "1", "x yasaktır, zorunludur"), (3, 0, "1", ""), (4, 0, "1", "x zorunludur, y yasaktır"), (4, 0, "1", "x zorunludur, y yasaktır"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, place int, number string, content string").withColumns({"subject": F.lit("clash"), "term": F.lit("clash"), "low": F.lit(1)})
    got = {(r.doc_id, r.number, r.finding): (r.about, r.other, r.n_others) for r in L.findings(df).collect()}
    assert got == {
        (1, "1", "contradiction"): ("taşıyıcı", "2", 1), (1, "2", "contradiction"): ("taşıyıcı", "2", 1), (1, "1", "conflicting_terms"): ("taşıyıcı", "2", 1), (1, "2", "conflicting_terms"): ("taşıyıcı", "1", 1),
        (1, "3", "exclusive"): ("sadece", "4", 1), (1, "4", "exclusive"): ("sadece,yalnızca", "3", 2), (1, "5", "exclusive"): ("yalnızca", "4", 1), (2, "2", "exceeding_exemption"): ("uçak", "1", 1), (4, "1", "contradiction"): ("x", "1", 2),
    }
    assert L.findings(df.limit(0)).count() == 0 and L.inherited_contradictions(df.limit(0)).count() == 0 and L.circular_references(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,authority,lacks,rank", [("Tebliğ", " ", True, 7), ("genelge", "3. madde", False, 8), ("KANUN", None, False, 2), (None, None, False, None), ("mektup", None, False, None)])
def test_norms(spark, kind, authority, lacks, rank):
    df = spark.createDataFrame([(kind, authority)], "kind string, authority string")
    assert tuple(df.select(L.lacks_authority(F.col("kind"), F.col("authority")), L.rank_of(F.col("kind"))).first()) == (lacks, rank)


def test_a_long_chain_of_conditions(spark):
    rows = [(7, i, str(i), f"eğer {i + 1}. madde varsa") for i in range(12)] + [(7, 12, "12", "gemi kullanılamaz"), (7, 13, "13", "gemi zorunludur; ise 12. madde"), (7, 14, None, "gemi yapılır 0. madde ise")]
    df = spark.createDataFrame(rows, "doc_id long, place int, number string, content string")
    got = {tuple(r) for r in L.inherited_contradictions(df).collect()}
    assert got == {(7, "13", "gemi", 0, 1)}
    looped = df.withColumn("content", F.when(F.col("number") == "12", "gemi kullanılamaz, 13. madde").otherwise(F.col("content")))
    assert {tuple(r) for r in L.circular_references(looped).collect()} == {(7, "12", 2), (7, "13", 2)}
