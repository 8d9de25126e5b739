"""Scores, reranking, diversity and verification over BM25's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import scores as S
from corpusmill.functions import text
from corpusmill.operators import joins, search
from corpusmill.plans.corpus import bm25_sql
from corpusmill.plans.registry import query
from corpusmill.session import table

_CANDIDATES = f"cand AS ({bm25_sql()})"
_PAIRS = f"WITH {_CANDIDATES}, pair AS (SELECT c.item_id, c.doc_id, c.score, b.text AS asked, d.text AS text, d.source, d.lang FROM cand c JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))"
_W = "regexp_extract_all(lower({}), '[^\\t-\\r ]+')"
_STOP = "(" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + ")"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each benchmark item, with both texts."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    best = search.bm25(docs.filter("text is not null"), table(spark, d, "benchmark"), 10).select("item_id", "doc_id", "score")
    return best.join(asked, "item_id").join(docs.select("doc_id", "text", "source", "lang"), "doc_id")


@query(
    _PAIRS
    + ", w AS (SELECT *, regexp_extract_all(lower(asked), '[a-z]+') AS q, regexp_extract_all(lower(text), '[a-z]+') AS t FROM pair), k AS (SELECT *, list_distinct(q) AS qs FROM w), "
    + "s AS (SELECT *, CASE WHEN len(qs) = 0 THEN 0 ELSE least(len(list_intersect(qs, list_distinct(t))) / len(qs) * 0.5 + least(len([x FOR x IN t IF list_contains(qs, x)]) / (len(t) + 1), 1) * 0.3 + (contains(lower(text), array_to_string(q, ' ')))::INT * 0.04, 1) END AS kw, "
    + "1990 + doc_id % 36 AS y, doc_id % 40 AS n FROM k) SELECT item_id, doc_id, round(kw, 5) AS kw, round(0.3 * kw + 0.25 * least(score / (3 * len(qs)), 1) + 0.15 * (CASE WHEN 2025 - y <= 0 THEN 1 WHEN 2025 - y <= 2 THEN 0.95 WHEN 2025 - y <= 5 THEN 0.85 WHEN 2025 - y <= 10 THEN 0.7 WHEN 2025 - y <= 20 THEN 0.5 ELSE 0.3 END) "
    + "+ 0.15 * 0.5 + 0.15 * (CASE WHEN n = 0 THEN 0.3 WHEN n <= 5 THEN 0.3 + n / 5 * 0.3 WHEN n <= 20 THEN 0.6 + (n - 5) / 15 * 0.2 ELSE least(0.8 + ln(n - 20) * 0.05, 1) END), 5) AS hybrid FROM s"
)
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, text (BM25 over three times the query's words), age, authority and citations, weighed; year and citations are made from the id."""
    q, t = text.tokens(F.col("asked"), "[a-z]+"), text.tokens(F.col("text"), "[a-z]+")
    rows = _pairs(spark, d).withColumns({"q": q, "t": t})
    kw = S.keyword(F.col("q"), F.col("t"), F.col("text"))
    semantic = F.least(F.col("score") / (3 * F.size(F.array_distinct("q"))), F.lit(1.0))
    total = S.hybrid(F.col("kw"), semantic, S.age_band(1990 + F.pmod("doc_id", F.lit(36)), 2025), S.authority_band(F.lit(None).cast("string"), F.col("source")), S.citation_curve(F.pmod("doc_id", F.lit(40))))
    return rows.withColumn("kw", kw).select("item_id", "doc_id", F.round("kw", 5).alias("kw"), F.round(total, 5).alias("hybrid"))


@query(
    _PAIRS
    + f", w AS (SELECT *, [x FOR x IN list_distinct({_W.format('asked')}) IF x NOT IN {_STOP}] AS q, [x FOR x IN list_distinct({_W.format('text')}) IF x NOT IN {_STOP}] AS t FROM pair), "
    + "s AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE least(len(list_intersect(q, t)) / len(q) + contains(lower(text), lower(asked))::INT * 0.3, 1) END AS heuristic, (doc_id % 12)::DOUBLE AS age FROM w), "
    + "f AS (SELECT item_id, doc_id, 0.6 * heuristic + 0.1 * (0.5 + CASE lang WHEN 'de' THEN 0.2 WHEN 'en' THEN 0.3 ELSE 0 END) + 0.1 * greatest(0, least(1, CASE WHEN age <= 5 THEN 1 - age * 0.05 ELSE 0.75 - (age - 5) * 0.1 END)) AS final FROM s) "
    + "SELECT item_id, doc_id, round(final, 5) AS final, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 5) DESC, doc_id) AS rank FROM f) WHERE rank <= 5"
)
def rerank_top5(spark: SparkSession, d: str) -> DataFrame:
    """Stages weighed 0.6 overlap, 0.2 legal references, 0.1 metadata, 0.1 age (type from the language, age from the id)."""
    kind = F.when(F.col("lang") == "en", "KANUN").when(F.col("lang") == "de", "YONETMELIK")
    none = F.array().cast("array<string>")
    final = S.weighted([(S.heuristic(F.col("asked"), F.col("text")), 0.6), (S.legal_overlap(none, none, none, none, F.lit(False)), 0.2), (S.metadata_score(kind, F.lit(""), F.col("asked")), 0.1), (S.ageing(F.pmod("doc_id", F.lit(12)).cast("double")), 0.1)])
    rows = _pairs(spark, d).select("item_id", "doc_id", F.round(final, 5).alias("final"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("final"), "doc_id"))).filter("rank <= 5")


@query(
    f"WITH {_CANDIDATES}, b AS (SELECT item_id, doc_id, score * (CASE WHEN doc_id % 3000 < 365 THEN 1.5 WHEN doc_id % 3000 < 1825 THEN 1.2 ELSE 1 END) * (CASE WHEN doc_id % 150 >= 100 THEN 1.3 WHEN doc_id % 150 >= 50 THEN 1.2 WHEN doc_id % 150 >= 10 THEN 1.1 ELSE 1 END) * (CASE WHEN contains(lower(text), 'the') THEN 1.5 ELSE 1 END) AS s FROM cand JOIN documents USING (doc_id)) "
    "SELECT item_id, doc_id, round(s, 4) AS boosted FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 4) DESC, doc_id) AS r FROM b) WHERE r <= 5"
)
def boosted_top5(spark: SparkSession, d: str) -> DataFrame:
    """Scores times boosts for recency, citations and terms contained, sorted anew."""
    s = F.col("score") * S.recency_boost(F.pmod("doc_id", F.lit(3000))) * S.citation_boost(F.pmod("doc_id", F.lit(150))) * S.term_boost(F.col("text"), {"the": 1.5})
    rows = _pairs(spark, d).select("item_id", "doc_id", F.round(s, 4).alias("boosted"))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("boosted"), "doc_id"))).filter("r <= 5").drop("r")


@query(
    _PAIRS
    + f", r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, list_distinct({_W.format('text')}[:100]) AS words FROM pair), "
    + "a AS (SELECT item_id, list({'rank': rank, 'doc_id': doc_id, 'words': words} ORDER BY rank) AS rows FROM r GROUP BY item_id), "
    + "k AS (SELECT item_id, list_reduce(rows, lambda kept, x: CASE WHEN len(kept) < 3 OR len([y FOR y IN kept IF len(list_intersect(x.words, y.words)) > 0.3 * len(list_distinct(list_concat(x.words, y.words)))]) = 0 THEN list_append(kept, x) ELSE kept END, rows[1:0]) AS kept FROM a) "
    + "SELECT item_id, x.doc_id AS doc_id, x.rank::INTEGER AS rank FROM (SELECT item_id, unnest(kept) AS x FROM k)"
)
def diverse_results(spark: SparkSession, d: str) -> DataFrame:
    """Results that resemble none kept before by more than 0.3 (distinct words of the first hundred), three at least."""
    first = F.array_distinct(F.slice(S.words(F.col("text")), 1, 100))
    ranked = _pairs(spark, d).select("item_id", F.struct(F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", first.alias("words")).alias("x"))
    lists = ranked.groupBy("item_id").agg(F.sort_array(F.collect_list("x")).alias("rows"))  # ten for an item
    return lists.select("item_id", F.explode(S.diverse(F.col("rows"), 0.3, 3)).alias("x")).select("item_id", "x.doc_id", "x.rank")


@query(
    _PAIRS
    + f", s AS (SELECT DISTINCT item_id, trim(unnest(string_split(asked, '.')), ' ') AS sentence FROM pair), t AS (SELECT *, [x FOR x IN list_distinct({_W.format('sentence')}) IF x NOT IN {_STOP}] AS q FROM s WHERE sentence <> ''), "
    + f"u AS (SELECT item_id, [x FOR x IN list_distinct({_W.format('text')}) IF x NOT IN {_STOP}] AS words FROM pair), "
    + "h AS (SELECT t.item_id, sentence, max(CASE WHEN len(q) > 0 AND len(list_intersect(q, words)) / len(q) > 0.3 THEN 1 ELSE 0 END) AS found FROM t JOIN u USING (item_id) GROUP BY ALL) "
    + "SELECT item_id, count(*) AS sentences, sum(found)::BIGINT AS found, round(sum(found) / count(*), 6) AS confidence, sum(found) / count(*) > 0.7 AS verified FROM h GROUP BY item_id"
)
def verified_answers(spark: SparkSession, d: str) -> DataFrame:
    """The share of a text's sentences of which some source has more than 0.3 of the words."""
    pairs = _pairs(spark, d).select("item_id", "asked", S.words(F.col("text")).alias("words"))
    said = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.transform(F.split("text", r"\."), lambda x: F.trim(x)))).alias("sentence")).filter("sentence <> ''")
    met = said.join(pairs.drop("asked"), "item_id").groupBy("item_id", "sentence").agg(F.max((S.overlap(S.words(F.col("sentence")), F.col("words")) > 0.3).cast("int")).alias("found"))
    return met.groupBy("item_id").agg(F.count("*").alias("sentences"), F.sum("found").alias("found"), F.round(F.sum("found") / F.count("*"), 6).alias("confidence"), (F.sum("found") / F.count("*") > 0.7).alias("verified"))


@query(
    _PAIRS
    + ", w AS (SELECT item_id, doc_id, text, regexp_extract_all(lower(asked), '[a-z]+')[:12] AS q FROM pair), g AS (SELECT item_id, doc_id, lower(text) AS t, array_to_string(q[i:i + n - 1], ' ') AS ph FROM w, (SELECT unnest([4, 3, 2]) AS n), (SELECT unnest(range(1, 12)) AS i) WHERE i <= len(q) - n + 1) SELECT item_id, doc_id, count(DISTINCT ph) AS phrases FROM g WHERE contains(t, ph) GROUP BY ALL"
)
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many runs of two to four of a query's first twelve words a document has."""
    q = F.slice(text.tokens(F.col("asked"), "[a-z]+"), 1, 12)
    return _pairs(spark, d).select("item_id", "doc_id", F.size(S.phrases(q, F.col("text"))).cast("long").alias("phrases")).filter("phrases > 0")


@query("SELECT c_custkey, round(0.5 * (c_acctbal + 1000) / 11000 + 0.5 * (0.5 * CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 0.8 ELSE 0.5 END + 0.3 * least(c_custkey % 30 / 20, 1) + 0.2 * greatest(pow(2, -(c_custkey % 40) / 5), 0.1)), 6) AS score FROM customer")
def precedent_scores(spark: SparkSession, d: str) -> DataFrame:
    """Half similarity, half authority: court, citations and a recency that halves every five years."""
    court = F.when(F.col("c_mktsegment") == "BUILDING", 1.0).when(F.col("c_mktsegment") == "MACHINERY", 0.8).otherwise(0.5)
    authority = S.weighted([(court, 0.5), (F.least(F.pmod("c_custkey", F.lit(30)) / 20, F.lit(1.0)), 0.3), (S.half_life(F.pmod("c_custkey", F.lit(40))), 0.2)])
    return table(spark, d, "customer").select("c_custkey", F.round(S.weighted([((F.col("c_acctbal") + 1000) / 11000, 0.5), (authority, 0.5)]), 6).alias("score"))


@query("WITH c AS (SELECT l_partkey AS topic, arg_min(l_suppkey, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'A') AS upheld_by, arg_min(l_suppkey, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'R') AS reversed_by FROM lineitem GROUP BY l_partkey) SELECT * FROM c WHERE upheld_by <> reversed_by")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose first upheld and first reversed case come from different chambers."""
    first = lambda flag: F.min_by("l_suppkey", F.when(F.col("l_returnflag") == flag, F.struct("l_orderkey", "l_linenumber")))
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("topic")).agg(first("A").alias("upheld_by"), first("R").alias("reversed_by"))
    return c.filter("upheld_by <> reversed_by")


@query("WITH w AS (SELECT o_custkey, o_orderpriority AS t, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), g AS (SELECT o_orderpriority AS t, count(*)::DOUBLE AS m FROM orders GROUP BY ALL) SELECT o_custkey, round(sum(n * m) / sqrt(sum(n * n)) / (SELECT sqrt(sum(m * m)) FROM g), 6) AS similarity FROM w JOIN g USING (t) GROUP BY o_custkey")
def topic_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each customer's map of topics with that of all."""
    o = table(spark, d, "orders")
    as_map = F.map_from_entries(F.collect_list(F.struct(F.col("o_orderpriority"), F.col("n").cast("double"))))
    own = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(as_map.alias("a"))
    every = o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).agg(as_map.alias("b"))  # one row, an entry for each priority
    return own.join(F.broadcast(every)).select("o_custkey", F.round(S.sparse_cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


_SYNONYMS = [("red", "crimson", 0.9), ("red", "scarlet", 0.8), ("red", "rust", 0.2), ("widget", "gadget", 0.7), ("ring", "band", 0.6), ("small", "little", 0.5)]


@query(
    "WITH syn(term, other, weight) AS (VALUES " + ", ".join(map(str, _SYNONYMS)) + "), t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part), "
    "x AS (SELECT p_partkey, pos, 0 AS r, term AS word FROM t UNION ALL SELECT p_partkey, pos, row_number() OVER (PARTITION BY p_partkey, pos ORDER BY weight DESC, other), other FROM t JOIN syn USING (term) WHERE weight >= 0.3) SELECT p_partkey, string_agg(word, ' ' ORDER BY pos, r) AS expanded FROM x WHERE r <= 2 GROUP BY p_partkey"
)
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Each word followed by its two heaviest synonyms, in order."""
    known = spark.createDataFrame(_SYNONYMS, "term string, other string, weight double")
    return joins.expand_words(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", known, most=2, least=0.3).withColumnRenamed("words", "expanded")


@query("SELECT item_id, CASE WHEN regexp_matches(lower(text), '(^| )(what|which)( |$)') THEN 'definition' WHEN regexp_matches(lower(text), '(^| )(how)( |$)') THEN 'procedure' WHEN regexp_matches(lower(text), '(^| )(the|le|la)( |$)') THEN 'named' ELSE 'factual' END AS kind FROM benchmark")
def question_types(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"definition": r"(^| )(what|which)( |$)", "procedure": r"(^| )(how)( |$)", "named": r"(^| )(the|le|la)( |$)"}
    return table(spark, d, "benchmark").select("item_id", text.first_matching(F.lower("text"), patterns, "factual").alias("kind"))


@query("WITH s AS (SELECT text, regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+') AS t FROM pages, (SELECT text FROM benchmark WHERE item_id = 0)), q AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS q FROM s) SELECT page_id, round(0.5 * len(list_intersect(q, list_distinct(t))) / len(q) + CASE WHEN ends_with(host, '.org') THEN 0.2 WHEN ends_with(host, '.net') THEN 0.1 ELSE 0 END, 6) AS score FROM q")
def web_scores(spark: SparkSession, d: str) -> DataFrame:
    """Half the share of a question's words in the title, and how credible the site's kind is."""
    asked = table(spark, d, "benchmark").filter("item_id = 0").select(F.array_distinct(text.tokens(F.col("text"), "[a-z]+")).alias("q"))  # one row
    title = text.tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[a-z]+")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    trust = F.when(F.endswith(host, F.lit(".org")), 0.2).when(F.endswith(host, F.lit(".net")), 0.1).otherwise(0.0)
    return table(spark, d, "pages").join(F.broadcast(asked)).select("page_id", F.round(0.5 * F.size(F.array_intersect("q", title)) / F.size("q") + trust, 6).alias("score"))
