"""Spans, windows, alerts, percentiles, checks and the classifier against plain Python."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import checks, dates, scores, spans, text, windows
from corpusmill.operators import audit, filters, graph, joins, stats

SF = "/root/testdata/sf0.001"
WORDS = ["ada@b.com", "x_y@q.org", "10.2.3.4", "1234 5678 9012 3456", "a@b.co_m@n.de", "tel", "+90 555 123 4567", "Madde 4", "x.", "y!", "\n", "z", "5 sayılı"]


def texts(n=120, words=WORDS, most=40):
    rnd = random.Random(4)
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(most))) for _ in range(n)] + ["", None]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, x string").repartition(3)


def test_emails_are_masked_as_by_the_plain_pattern(spark):
    plain = re.compile(r"([A-Za-z0-9._%+-]{1,3})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})")
    got = {r.x: r.y for r in frame(spark, texts()).select("x", text.mask_email(F.col("x")).alias("y")).collect()}
    assert all(y == (None if x is None else plain.sub(r"\1***@\2", x)) for x, y in got.items())


def test_spans_and_redaction(spark):
    patterns = (spans.Pattern("email", text.EMAIL, 0.95), spans.Pattern("ip", text.IP, 0.7, "tel"), spans.Pattern("number", r"[0-9]+", 0.4))
    kept = spans.resolve(spans.all_spans(F.col("x"), patterns))
    got = frame(spark, texts()).select("x", kept.alias("k")).select("x", "k", *[spans.redact(F.col("x"), F.col("k"), s).alias(s) for s in spans.STRATEGIES]).collect()
    for r in got:
        x, found = r.x or "", []
        for p in patterns:
            for m in re.finditer(p.pattern, x):
                near = x[max(0, m.start() - 20) : m.end() + 20]
                sure = min(1.0, p.confidence + 0.2) if p.context and re.search(p.context, near, re.IGNORECASE) else p.confidence
                found.append((m.start(), -sure, p.kind, m.end()))
        want, last = [], -1
        for start, sure, kind, end in sorted(found):
            if start >= last:
                want.append((start, end, kind, round(-sure, 6)))
                last = end
        assert [(s.start, s.end, s.kind, round(s.confidence, 6)) for s in r.k] == want
        out, at = "", 0
        for start, end, kind, _ in want:
            out, at = out + x[at:start] + spans.PLACEHOLDERS.get(kind, f"[{kind.upper()}]"), end
        assert r.replace == (None if r.x is None else out + x[at:]) and (r.x is None or "@" not in r.mask or all(s.kind != "email" for s in r.k) or "*" in r.mask)
    overlapping = frame(spark, ["ab abc"]).select(F.expr("array(named_struct('start',0,'end',2),named_struct('start',0,'end',6),named_struct('start',5,'end',9))").alias("s"))
    assert [tuple(s)[:2] for s in overlapping.select(spans.longest_first(F.col("s"))).first()[0]] == [(0, 6)]


def plain_windows(t, size, stride):
    """As the feature is described, step by step."""
    end_of = re.compile(windows.SENTENCE_END)
    out, at = [], 0
    while at < len(t):
        end = at + size
        if end >= len(t):
            end = len(t)
        else:
            after = [m for m in end_of.finditer(t) if m.start() >= end and m.end() <= end + windows.REACH]
            before = [m for m in end_of.finditer(t) if m.end() <= end and m.start() >= end - windows.REACH]
            end = after[0].end() if after else before[-1].end() if before else end
        if not t[at:end].strip():
            at = max(end, at + 1)
            continue
        out.append((at, end))
        w = t[at:end]
        near = re.search(windows.ARTICLE, w) or re.search(windows.AMENDMENT, w)
        at += max(stride // 2, windows.LEAST) if near else max(int(stride * 0.75), windows.LEAST) if re.search(windows.CITATION, w) else stride
    return out


def test_sliding_windows(spark):
    given = texts(60, most=400) + ["a" * 3000, " " * 900, "word. " * 300]
    got = {}
    for r in windows.sliding(frame(spark, given), "i", "x").orderBy("doc_id", "chunk").collect():
        assert r.window == given[r.doc_id][r.start : r.stop]
        got.setdefault(r.doc_id, []).append((r.start, r.stop))
    assert got == {i: w for i, t in enumerate(given) if (w := plain_windows(t or "", windows.SIZE, windows.STRIDE))}


def test_windows_of_marked_texts_and_one_lower_case_text(spark):
    rnd = random.Random(4)
    bits = ["Madde 12 ", "MADDE 7. ", "Madde x ", "123 sayılı ", "sayılı ", "eklenmiştir. ", "abc ", "def ghi. ", "lorem ipsum dolor "]
    for n in range(60):
        t = "".join(rnd.choice(bits[(n % 3) * 3 :]) for _ in range(200))
        assert windows.bounds(t) == plain_windows(t, windows.SIZE, windows.STRIDE)
    df = frame(spark, ["The house of und.\n\t ", "word, \v\f", "", " ", "x", "the " * 3 + "word " * 30, None])
    made = df.select("i", spans.completeness(F.col("x")), spans.coherence(F.col("x"), ("the", "und", "of")))
    assert [tuple(r)[1:] for r in made.orderBy("i").collect()] == [(1.0, 0.7), (0.5, 0.6), (0.0, 0.6), (0.0, 0.6), (0.3, 0.6), (0.3, 0.6), (0.3, 0.6)]
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_alerts_are_silenced_by_the_last_one_sent(spark):
    rnd = random.Random(1)
    rows = [(i, f"k{rnd.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(20_000))) for i in range(300)] + [(900 + i, "steady", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=4 * i)) for i in range(20)]
    last, want = {}, set()
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= 300:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp").repartition(3)
    assert {r.event_id for r in audit.alerts(df, ["k"], "ts", "event_id", 300).collect()} == want and 902 in want


def test_percentiles_of_heavy_tails_and_repeats(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.paretovariate(0.3)) for _ in range(3000)] + [("b", 5.0)] * 4000 + [("b", float(i)) for i in range(9)] + [("c", 1.0), (None, None)]
    got = {r.g: (r.p, r.q, r.z) for r in stats.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", {"p": 0.5, "q": 0.95, "z": 1.0}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == tuple(v[min(int(len(v) * p), len(v) - 1)] for p in (0.5, 0.95, 1.0))


def test_nearest_numbers(spark):
    known, asked = [5, 9, 10_000, 20_001], [1, 7, 8, 4_000, 9_999, 15_001, 50_000]
    n = lambda v: spark.createDataFrame([(x,) for x in v], "k long")
    got = {r.k: r.nearest for r in joins.nearest_number(n(asked), n(known), "k", block=64).collect()}
    assert got == {a: min(known, key=lambda x: (abs(x - a), x)) for a in asked}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a")], "src string, dst string")
    assert {(r.node, r.length) for r in graph.cyclic(e).collect()} == {("a", 3), ("b", 3), ("c", 3)}
    nodes = spark.createDataFrame([(n, 0.5) for n in "abcdex"], "node string, credibility double")
    got = {r.node: (r.trust, r.n_paths) for r in graph.trust(e, nodes, F.col("node") == "e", 5).collect()}
    assert got["d"] == (0.25, 1) and got["e"] == (0.5, 1) and got["x"] == (0.5**6, 1)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "function,value,want",
    [
        (checks.valid_phone, "+90 (532) 123-45-67", True), (checks.valid_phone, "0212 123 45 67", False), (checks.valid_phone, None, False), (checks.format_phone, "5321234567", "+90 532 123 45 67"), (checks.valid_tax_number, "123", False),
        (checks.valid_email, "a@b.co", True), (checks.valid_email, "a@b", False), (checks.valid_url, "https://a.b/c", True), (checks.valid_url, "ftp://a", False), (checks.file_extension, "a.b.TXT", "txt"), (checks.file_extension, "none", ""),
        (checks.safe_filename, "a b?/c.txt", "a_bc.txt"), (checks.delay_days, "2 AY sonra", 60), (checks.delay_days, "bugün", None), (checks.tidy_spaces, " a  b\n\n\n\nc ", "a b\n\nc"), (checks.is_heading, " SECTION ONE ", True), (checks.is_heading, "Madde 5", True), (checks.is_heading, "plain", False),
        (lambda x: checks.cut_off(x, 6), "abcdefgh", "abc..."), (lambda x: checks.within_tokens(x, 1), "abcdefgh", "abcd..."), (lambda x: checks.relative_date(x, F.lit("2024-03-31").cast("date")), "geçen ay", dt.date(2024, 2, 29)),
        (lambda x: checks.relative_date(x, F.lit("2024-03-31").cast("date")), "dün", dt.date(2024, 3, 30)), (dates.mentions, "on 5 Mart 2021 and 1.2.2020", ["5 Mart 2021", "1.2.2020"]), (lambda x: dates.date_range(x)["end"], "1.2.2020 - 3 Mart 2021", dt.date(2021, 3, 3)),
        (spans.completeness, "End. ", 1.0), (spans.completeness, "so,", 0.5), (spans.completeness, " ", 0.0), (scores.words, " A  b\n", ["a", "b"]),
    ],
)
def test_checks(spark, function, value, want):
    assert one(spark, value, function) == want


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, ["b"], dt.datetime(2024, 5, 1)), (3, [], dt.datetime(2020, 1, 1))], "k int, tags array<string>, t timestamp")
    ids = lambda c: [r.k for r in df.filter(c).orderBy("k").collect()]
    assert ids(filters.any_of(F.col("tags"), ["a", "z"])) == [1] and ids(filters.all_of(F.col("tags"), ["b"])) == [1, 2] and ids(filters.within(F.col("t"), "2024-01-01")) == [1, 2]
    assert ids(filters.every([None, filters.condition("k", "gte", 2)])) == [2, 3] and ids(filters.decide(F.col("k") == 3, [filters.listed(F.col("k").cast("string"), ["1"]), filters.listed(F.col("k").cast("string"), None)])) == [1, 3]


def test_classifier_on_its_labels(spark):
    got = {r.doc_id: r for r in catalogue.queries()["document_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality is not None and r.doc_id in got}
    right = sum(got[i].predicted == q for i, q in labels.items())
    assert right >= 0.8 * len(labels) and all(0 <= r.uncertainty <= 1.0001 and r.needs_review == (max(r.probability, 1 - r.probability) < 0.7) for r in got.values() if abs(max(r.probability, 1 - r.probability) - 0.7) > 1e-5)


def test_classifier_counts_terms_of_labelled_texts_once(spark, monkeypatch):
    from corpusmill.plans import corpus

    kept, told = corpus.durable, []
    monkeypatch.setattr(corpus, "durable", lambda df: told.append(df.columns) or kept(df))
    assert catalogue.queries()["document_classifier"](spark, "/root/testdata/sf0.001").count() > 0 and told == [["label", "tf"]]


def test_spans_of_a_long_text_take_linear_time(spark):
    import time

    line = "ab@cd.com say hello to 10.0.0.1. "
    took = []
    for n in (5_000, 50_000):
        df = frame(spark, [line * n]).withColumn("k", spans.resolve(spans.all_spans(F.col("x"), (spans.Pattern("email", text.EMAIL), spans.Pattern("ip", text.IP)))))
        began = time.time()
        size, red, packed = df.select(F.size("k"), spans.redact(F.col("x"), F.col("k"), "replace"), F.size(spans.packed(F.split("x", r"[.!?] ", -1), 512))).first()
        took.append(time.time() - began)
        assert size == 2 * n and red == "[E-POSTA] say hello to [IP-ADRESI]. " * n and packed > n // 30
    assert took[1] < 20 * took[0] + 5


def test_ranks_do_not_depend_on_the_order_of_merged_parts(spark, monkeypatch):
    """Approximate bounds may differ from one evaluation to the next; here they always do."""
    rows = spark.createDataFrame([(g, float(v * v % 997)) for g in range(2) for v in range(600)], "g int, v double").repartition(4)
    plain = F.percentile_approx
    moved = F.udf(lambda cuts: [c + random.uniform(-40, 40) for c in cuts], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: F.array_sort(moved(plain(*a))))
    shares = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.95}
    ranked = sorted(float(v * v % 997) for v in range(600))
    want = tuple(ranked[int(600 * p)] for p in shares.values())
    assert [tuple(r)[1:] for r in stats.nearest_rank(rows, "g", "v", shares).collect()] == [want, want]


def test_parts_split_a_text_once(spark):
    """20,000 marks in a text, which was split again for each; and texts with odd places of marks."""
    given = [(1, " a \nMadde 1 b\tMadde 2"), (2, "Madde 7"), (3, ""), (4, " \n"), (5, None), (6, "Madde 3Madde 4 "), (7, "".join(f"Madde {i} text\n" for i in range(20_000)))]
    df = spark.createDataFrame(given, "i int, x string").repartition(2)
    began = time.monotonic()
    got = {r.i: r.p if r.p is None else [tuple(p) for p in r.p] for r in df.select("i", spans.marked_parts(F.col("x"), "Madde +[0-9]+").alias("p")).collect()}
    assert time.monotonic() - began < 20
    assert got.pop(7) == [("part", f"Madde {i} text") for i in range(20_000)]
    assert got == {1: [("preamble", "a"), ("part", "Madde 1 b"), ("part", "Madde 2")], 2: [("part", "Madde 7")], 3: [], 4: [], 5: None, 6: [("part", "Madde 3"), ("part", "Madde 4")]}


def test_bm25_adds_no_filter_that_splits_texts_again(spark):
    from corpusmill.operators import search

    docs = spark.createDataFrame([(1, "abc def"), (2, ""), (3, "!"), (4, "abc abc")], "doc_id long, text string")
    made = search.bm25(docs, spark.createDataFrame([(7, "abc")], "item_id long, text string"))
    assert sorted(r.doc_id for r in made.collect()) == [1, 4]
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Filter" in x and "regexp_extract_all" in x and "array_distinct" not in x for x in plan)
