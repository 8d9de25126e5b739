"""Text, quality, versions, retrieval and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import graph, joins, search, stats
from corpusmill.plans.registry import query
from corpusmill.session import durable, table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query("SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {_q(text.EMAIL)})) AS emails, len(regexp_extract_all(text, {_q(text.IP)})) AS ips, len(regexp_extract_all(text, {_q(text.CARD)})) AS cards, len(regexp_extract_all(text, {_q(text.PHONE)})) AS phones FROM documents")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n(text.EMAIL).alias("emails"), n(text.IP).alias("ips"), n(text.CARD).alias("cards"), n(text.PHONE).alias("phones"))


@query(
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})', '****-****-****-\\1', 'g'), "
    "'\\b[1-9][0-9]{8}([0-9]{2})\\b', '*********\\1', 'g'), '([A-Za-z0-9._%+-]{1,3})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', '\\1***@\\2', 'g'), "
    "'([0-9]{1,3})\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '\\1.*.*.*', 'g')) AS masked_md5 FROM documents"
)
def masked_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.mask_personal(F.col("text"))).alias("masked_md5"))


@query("SELECT doc_id, kind, length(found) AS size, sha256(found)[:16] AS hash FROM (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, " + _q(text.EMAIL) + ")) AS found FROM documents UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(text, " + _q(text.IP) + ")) FROM documents)")
def personal_entities(spark: SparkSession, d: str) -> DataFrame:
    each = lambda kind, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.concat(each("email", text.EMAIL), each("ip", text.IP))).alias("e"))
    return rows.select("doc_id", "e.kind", F.length("e.found").cast("long").alias("size"), F.substring(F.sha2("e.found", 256), 1, 16).alias("hash"))


@query(
    "SELECT doc_id, CASE WHEN w > 0 THEN round(greatest(0.0, least(100.0, 100 - 2 * (1.5 * c / w + 0.5 * w / s))), 4) ELSE 0.0 END AS score FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::DOUBLE AS w, "
    "greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE AS s, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))::DOUBLE AS c FROM documents)"
)
def readability_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(text.readability(F.col("text")), 4).alias("score"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 50")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"), "[a-z]{4,}")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("SELECT doc_id, i::INTEGER AS chunk, md5(substr(text, i * 256 + 1, 512)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, (length(text) - 257) // 256))) AS i FROM documents WHERE length(text) > 0)")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 257) / 256).cast("int"))
    rows = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("doc_id", "chunk", F.md5(F.substring(F.col("text"), F.col("chunk") * 256 + 1, F.lit(512))).alias("chunk_md5"))


@query("SELECT doc_id, (len(parts))::BIGINT AS sentences, coalesce(list_max([length(x) FOR x IN parts]), 0)::BIGINT AS longest FROM (SELECT doc_id, [trim(x, ' ') FOR x IN regexp_extract_all(text, '[^.!?]+[.!?]*') IF trim(x, ' ') <> ''] AS parts FROM documents)")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


@query("SELECT source, round(avg((text IS NOT NULL)::INT), 6) AS has_text, round(avg((lang IS NOT NULL)::INT), 6) AS has_lang, count(*) FILTER (regexp_matches(text, 'Ã.|Ä.|Å.|�')) AS mojibake FROM documents GROUP BY source")
def field_presence(spark: SparkSession, d: str) -> DataFrame:
    there = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return table(spark, d, "documents").groupBy("source").agg(there("text").alias("has_text"), there("lang").alias("has_lang"), F.count_if(F.col("text").rlike(text.MOJIBAKE)).alias("mojibake"))


@query("SELECT doc_id, round((n_chars - m) / s, 6) AS z FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) WHERE abs((n_chars - m) / s) > 3")
def anomaly_zscore(spark: SparkSession, d: str) -> DataFrame:
    return stats.z_outliers(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", F.round("z", 6).alias("z"))


@query("SELECT doc_id, d.source FROM documents d JOIN (SELECT source, list_sort(list(n_chars)) AS s, count(n_chars) AS n FROM documents GROUP BY source) q ON d.source IS NOT DISTINCT FROM q.source WHERE n_chars < s[n // 4 + 1] - 1.5 * (s[3 * n // 4 + 1] - s[n // 4 + 1]) OR n_chars > s[3 * n // 4 + 1] + 1.5 * (s[3 * n // 4 + 1] - s[n // 4 + 1])")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return stats.iqr_outliers(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars").select("doc_id", "source")


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'modified' END AS change FROM (SELECT doc_id // 2 AS k, text FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id // 2 AS k, text FROM documents WHERE doc_id % 2 = 1) b ON a.k = b.k) GROUP BY change")
def diff_full_outer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("k"), F.xxhash64("text").alias("h"), F.pmod("doc_id", F.lit(2)).alias("odd"))
    return joins.changes(docs.filter("odd = 0"), docs.filter("odd = 1"), "k", "h").groupBy("change").agg(F.count("*").alias("n"))


@query(
    "SELECT k AS o_orderkey, conflict FROM (SELECT coalesce(b.k, o.k, t.k) AS k, (o.v IS DISTINCT FROM b.v AND t.v IS DISTINCT FROM b.v AND o.v IS DISTINCT FROM t.v) AS conflict FROM (SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) b "
    "FULL JOIN (SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) o ON b.k = o.k FULL JOIN (SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) t ON coalesce(b.k, o.k) = t.k)"
)
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: table(spark, d, "lineitem").filter(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("v"))
    return joins.merge_three_way(side(1), side(2), side(3), "o_orderkey", "v").select("o_orderkey", "conflict")


def bm25_sql(word: str = text.WORD) -> str:
    """The ten best documents of each benchmark item by BM25 over the matches of `word` (an expression without quotes)."""
    return """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark),
total AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM docs),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, term, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (term), total),
scored AS (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM part JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 10""".replace("{WORD}", word)


@query(bm25_sql())
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of every benchmark item over all documents, by every word and number of any script."""
    docs = table(spark, d, "documents").filter("text is not null")
    return search.bm25(docs, table(spark, d, "benchmark"), 10).select("item_id", "doc_id", "score")


@query(
    "SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score "
    "FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 AND e.embedding IS NOT NULL AND q.embedding IS NOT NULL)) WHERE r <= 10"
)
def cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors, exactly, for every id divisible by 100."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest(v, v.filter("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "score")


@query("SELECT source, lang, count(*) AS n FROM documents WHERE contains(lower(text), 'the') GROUP BY GROUPING SETS ((source), (lang))")
def facets(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("the")))
    return hits.groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n")).select("source", "lang", "n")


@query("SELECT doc_id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || substr(text, s, 300) || (CASE WHEN s + 300 <= length(text) THEN '...' ELSE '' END) AS snippet FROM (SELECT doc_id, text, greatest(1, CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 150 ELSE 1 END) AS s FROM documents WHERE contains(lower(text), 'the'))")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", text.snippet(F.col("text"), "the").alias("snippet"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def html_outline(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<a [^>]*href=").alias("links"), n("<p[ >]").alias("paragraphs"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[ >].*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS text_md5 FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[ >].*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.md5(text.collapse(bare)).alias("text_md5"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Edges as often as the table has them."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).distinct()


_EDGES = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


@query(f"WITH e AS ({_EDGES}) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, round(least((0.6 * sum(i) + 0.2 * sum(o)) / 100, 1.0), 6) AS authority FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def citation_degrees(spark: SparkSession, d: str) -> DataFrame:
    score = F.least((0.6 * F.col("n_in") + 0.2 * F.col("n_out")) / 100, F.lit(1.0))
    return graph.degrees(_edges(spark, d)).withColumn("authority", F.round(score, 6))


@query(f"WITH e AS ({_EDGES}), one AS (SELECT DISTINCT dst AS node FROM e WHERE src = 's1'), two AS (SELECT DISTINCT src AS node FROM e JOIN one ON dst = node WHERE src <> 's1') SELECT 's1' AS node, 0 AS level UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two")
def ego_network(spark: SparkSession, d: str) -> DataFrame:
    e = _links(spark, d)
    return graph.reach(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), spark.range(1).select(F.lit("s1").alias("node")), 2)


@query("SELECT source, arg_max(doc_id, n_chars * 1000000000 + doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def largest_of_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query()
def document_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Quality of documents by TF-IDF of words and word pairs and logistic regression; probability, entropy and whether a person should look."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = docs.join(table(spark, d, "labels").filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")), "doc_id")
    terms = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}0-9]+"),
        NGram(inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=1 << 16),
    ]
    counted = Pipeline(stages=terms).fit(labelled)
    # each of the fits goes through the labelled rows again, but not through their texts
    learnt = Pipeline(stages=[IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(maxIter=20, regParam=0.01)]).fit(durable(counted.transform(labelled).select("label", "tf")))
    p = vector_to_array("probability")[1]
    entropy = -(p * F.log(p + 1e-10) + (1 - p) * F.log(1 - p + 1e-10)) / F.log(F.lit(2.0))
    made = learnt.transform(counted.transform(docs))
    return made.select("doc_id", F.col("prediction").cast("int").alias("predicted"), F.round(p, 6).alias("probability"), F.round(entropy, 6).alias("uncertainty"), (F.greatest(p, 1 - p) < 0.7).alias("needs_review"))
