import datetime as dt
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import dates, text
from corpusmill.operators import joins, search, stats
from corpusmill.sources import tables
from corpusmill.streaming import alerts

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con

#: Queries that find nothing at this size.
MAY_BE_EMPTY = {"failed_threshold_15min", "sequence_gaps", "rate_limited", "numbering_issues"}


def plain(rows):
    each = lambda v: f"{float(v):.5f}" if isinstance(v, float) else str(v)
    return sorted([[each(v) for v in r] for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_and_sql_agree(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    want = rel.fetchall()
    assert plain(got.select(*rel.columns).collect()) == plain(want)
    assert want or name in MAY_BE_EMPTY


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "function,value,want",
    [
        (text.latinize, "çok İyi", "cok Iyi"), (text.slug, " Şu Bir: Başlık! ", "su-bir-baslik"), (text.collapse, " a \n\t b ", "a b"), (text.mask_email, "x jonathan@a.com", "x jon***@a.com"), (text.mask_ip, "at 10.20.30.40", "at 10.*.*.*"),
        (text.mask_card, "1234 5678 9012 3456", "****-****-****-3456"), (text.mask_national_id, "no 10000000146.", "no *********46."), (text.valid_national_id, "10000000146", True), (text.valid_national_id, "10000000147", False), (text.valid_national_id, None, False),
        (text.valid_iban, "TR33 0006 1005 1978 6457 8413 26", True), (text.valid_iban, "TR33 0006 1005 1978 6457 8413 27", False), (text.sentences, "A b. C? d", ["A b.", "C?", "d"]), (text.readability, "", 0.0),
        (dates.parse_date, "5 Şubat 2021", dt.date(2021, 2, 5)), (dates.parse_date, "05.02.49", dt.date(2049, 2, 5)), (dates.parse_date, "2021-02-05", dt.date(2021, 2, 5)), (dates.parse_date, "x", None), (dates.parse_date, None, None),
    ],
)
def test_functions(spark, function, value, want):
    assert one(spark, value, function) == want


def test_business_days_and_validity(spark):
    d = spark.createDataFrame([(dt.date(2024, 3, 1),)], "d date")
    assert d.select(dates.add_business_days(F.col("d"), 6)).first()[0] == dt.date(2024, 3, 11)
    day = lambda x: F.lit(x).cast("date")
    on = [d.select(dates.active_on(F.col("d"), day("2024-01-01"), day(e), day(r))).first()[0] for e, r in ((None, None), ("2024-04-01", None), (None, "2024-03-01"), (None, "2024-03-02"))]
    assert on == [True, False, False, True]


def test_nearest_rank_with_ties_and_nulls(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 2.0)] * 50 + [("b", 9.0)] + [(None, 1.0), (None, 2.0), ("c", None)]
    got = {r.g: (r.p, r.q) for r in stats.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p": 0.5, "q": 0.99}, buckets=7).collect()}
    assert got == {"a": (50.0, 99.0), "b": (2.0, 9.0), None: (2.0, 2.0)}


def test_three_way_merge(spark):
    v = lambda **k: spark.createDataFrame(list(k.items()), "k string, v string")
    got = joins.merge_three_way(v(a="1", b="1", c="1", d="1"), v(a="2", b="1", c="2", e="5"), v(a="1", b="3", c="3", d="1"), "k", "v").collect()
    assert {r.k: (r.merged, r.conflict) for r in got} == {"a": ("2", False), "b": ("3", False), "c": (None, True), "d": (None, False), "e": ("5", False)}


@pytest.mark.parametrize("name", ["parquet", "json", "csv", "xml"])
def test_sources_round_trip(spark, tmp_path, name):
    df = spark.createDataFrame([("1", "a"), ("2", "b,\"c\"")], "id string, x string")
    tables.write(df, name, str(tmp_path / name))
    assert sorted((str(r.id), r.x) for r in tables.read(spark, name, str(tmp_path / name)).collect()) == [("1", "a"), ("2", 'b,"c"')]
    assert sorted(r.x for r in tables.upsert(df, df.filter("id = '1'").withColumn("x", F.lit("z")), "id").collect()) == ['b,"c"', "z"]
    assert tables.unseen(df, df.limit(1), ["id"]).count() == 1 and tables.ntriples(df, "id", "urn:").count() == 2


def test_streams_go_on_where_they_ended(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    given.filter("event_id < 600").write.parquet(folder)
    stream = lambda: alerts.first_of_each(alerts.events(spark, folder, given.schema).withColumn("ts", F.col("ts").cast("timestamp")))
    alerts.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    given.filter("event_id >= 590").write.mode("append").parquet(folder)
    alerts.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("event_id").distinct().count() == got.count() == given.count()
    rates = alerts.error_rates(alerts.events(spark, folder, given.schema).withColumn("ts", F.col("ts").cast("timestamp")))
    alerts.run_once(rates, str(tmp_path / "rates"), str(tmp_path / "c2"))
    assert all(r.errors > 0.05 * r.n for r in spark.read.parquet(str(tmp_path / "rates")).collect())


def test_bm25_of_short_and_accented_words(spark, monkeypatch):
    docs = [(1, "où été 7 le 7"), (2, "Der Bär"), (3, "le le chat"), (4, None), (5, ""), (6, "slow, 日本 bär")]
    asked = [(10, "Été, le 7!"), (11, "bär"), (12, "BAR b r t"), (13, "日本")]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    sizes = {i: words(t) for i, t in docs if t is not None}
    mean, want = sum(map(len, sizes.values())) / len(sizes), {}
    for q, t in asked:
        for i, w in sizes.items():
            for x in set(words(t)) & set(w):
                n = sum(x in v for v in sizes.values())
                want[q, i] = want.get((q, i), 0) + math.log((len(sizes) - n + 0.5) / (n + 0.5) + 1) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    for most in (search.BROADCAST_TERMS, 0):
        monkeypatch.setattr(search, "BROADCAST_TERMS", most)
        got = {(r.item_id, r.doc_id): r.score for r in search.bm25(frame(docs, "doc_id").filter("text is not null"), frame(asked, "item_id")).collect()}
        assert got == pytest.approx(want, abs=1e-6) and {i for i, _ in got} == {10, 11, 13}


def test_exact_search_multiplies_blocks(spark, capfd):
    """Blocks meet blocks, as matrices: no fold of components for each pair of rows; of many copies the smallest ids count."""
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0] if i < 80 else [float(i % 7), 1.0, float(i % 3)]) for i in range(100)], "vec_id long, embedding array<float>").repartition(4)
    found = search.nearest(v, v.filter("vec_id % 20 = 0"), 5, block_rows=16, block_queries=2)
    got = {(r.query_id, r.rank): r.vec_id for r in found.collect()}
    assert [got[40, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]
    found.explain()
    assert "MapInArrow" in capfd.readouterr().out


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_search_of_every_query(spark, block):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(1, 60)] + [(i, [1.0, 2.0, 0.0, 1.0]) for i in (100, 101, 102)]
    odd = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [1.0] * 3), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = search.nearest(v, v.filter("vec_id % 20 = 0 or vec_id > 200"), 10, block_rows=block, block_queries=max(1, block // 4)).collect()
    size = lambda x: math.sqrt(sum(a * a for a in x))
    for q, x in rows:
        if q % 20 == 0:
            near = sorted((-round(sum(a * b for a, b in zip(x, y)) / size(x) / size(y), 6), i) for i, y in rows if i != q)[:10]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == near
    assert {r.query_id for r in got} == {20, 40, 100}
    every = catalogue.queries()["cosine_top10"](spark, SF).groupBy("query_id").count().collect()
    assert sorted(map(tuple, every)) == [(i, 10) for i in range(0, 500, 100)]
