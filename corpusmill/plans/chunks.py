"""Sliding windows, conversations as text, quality of chunks, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import spans, text, windows
from corpusmill.operators import folds, stats
from corpusmill.plans.registry import query
from corpusmill.session import ship, table

CONNECTIVES = ("ancak", "fakat", "ve", "the", "und", "of")


@query()
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 512 characters that end at sentences, with strides that marks shorten; completeness and coherence of each. The tests hold it against a plain loop."""
    ship(spark)
    w = windows.sliding(table(spark, d, "documents"))
    return w.select("doc_id", "chunk", "start", "stop", "overlap", F.md5("window").alias("window_md5"), spans.completeness(F.col("window")).alias("completeness"), spans.coherence(F.col("window"), CONNECTIVES).alias("coherence"))


@query(
    "WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY r DESC)) AS context_md5, count(*) AS turns FROM c WHERE r <= 5 GROUP BY conv_id"
)
def recent_context(spark: SparkSession, d: str) -> DataFrame:
    """The last five turns of each conversation as one text, oldest first."""
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    last = table(spark, d, "conversations").withColumn("r", r).filter("r <= 5")
    lines = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("r"), F.concat_ws(": ", "role", "text").alias("line")))), lambda x: x["line"])
    return last.groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("context_md5"), F.count("*").alias("turns"))


@query("SELECT doc_id, CASE WHEN last = '' THEN 0.0 WHEN last IN ('.', '!', '?') THEN 1.0 WHEN last IN (',', ';', ':') THEN 0.5 ELSE 0.3 END::DOUBLE AS completeness, (CASE WHEN share BETWEEN 0.05 AND 0.15 THEN 0.9 WHEN share < 0.05 THEN 0.6 ELSE 0.7 END)::DOUBLE AS coherence FROM (SELECT doc_id, right(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+$', ''), 1) AS last, (" + " + ".join(f"contains(lower(text), '{c}')::INT" for c in CONNECTIVES) + ") / greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 1) AS share FROM documents WHERE text IS NOT NULL)")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", spans.completeness(x).alias("completeness"), spans.coherence(x, CONNECTIVES).alias("coherence"))


@query("SELECT source, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS small, sum(len(regexp_extract_all(text, 'The')))::BIGINT AS large, round(greatest(sum(len(regexp_extract_all(text, 'the'))), sum(len(regexp_extract_all(text, 'The')))) / nullif(sum(len(regexp_extract_all(text, 'the'))) + sum(len(regexp_extract_all(text, 'The'))), 0), 6) AS modal_share FROM documents WHERE text IS NOT NULL GROUP BY source")
def terminology(spark: SparkSession, d: str) -> DataFrame:
    """How far one spelling of a term prevails."""
    n = lambda w: F.sum(F.regexp_count("text", F.lit(w)))
    c = table(spark, d, "documents").filter("text is not null").groupBy("source").agg(n("the").alias("small"), n("The").alias("large"))
    return c.withColumn("modal_share", F.round(F.try_divide(F.greatest("small", "large"), F.col("small") + F.col("large")), 6))


@query(
    f"WITH w AS (SELECT source, unnest(regexp_extract_all(text, '{text.WORD}')) AS word FROM documents WHERE text IS NOT NULL), c AS (SELECT source, lower(word) AS term, word, count(*) AS n FROM w GROUP BY ALL) "
    "SELECT source, term, count(*) AS spellings, sum(n)::BIGINT AS n, min(word) FILTER (n = most) AS prevailing, round(max(n) / sum(n), 6) AS modal_share, max(n) < 0.8 * sum(n) AS inconsistent FROM (SELECT *, max(n) OVER (PARTITION BY source, term) AS most FROM c) GROUP BY source, term HAVING count(*) > 1"
)
def term_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every term of a source that is spelt in more than one way, and how far one spelling prevails; a frequent term is summed up before its shuffle."""
    words = table(spark, d, "documents").filter("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit(text.WORD), F.lit(0))).alias("word"))
    each = words.groupBy("source", F.lower("word").alias("term"), "word").agg(F.count("*").alias("n"))
    terms = each.groupBy("source", "term").agg(F.count("*").alias("spellings"), F.sum("n").alias("total"), F.max("n").alias("most"), F.min(F.struct(-F.col("n"), F.col("word"))).alias("first"))
    return terms.filter("spellings > 1").select("source", "term", "spellings", F.col("total").alias("n"), F.col("first.word").alias("prevailing"), F.round(F.col("most") / F.col("total"), 6).alias("modal_share"), (F.col("most") < 0.8 * F.col("total")).alias("inconsistent"))


@query("SELECT source, count(*) AS n, round(avg(filled), 6) AS completeness, count(*) FILTER (filled < 0.5) AS errors, count(*) FILTER (filled >= 0.5 AND filled < 0.8) AS warnings FROM (SELECT source, ((doc_id IS NOT NULL)::INT + (coalesce(text, '') <> '')::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars > 500)::INT) / 5 AS filled FROM documents) GROUP BY source")
def completeness_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The share of five fields filled: under a half is an error, under four fifths a warning."""
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    filled = (yes(F.col("doc_id").isNotNull()) + yes(F.coalesce("text", F.lit("")) != "") + yes(F.col("lang").isNotNull()) + yes(F.col("source").isNotNull()) + yes(F.col("n_chars") > 500)) / 5
    f = table(spark, d, "documents").select("source", filled.alias("filled"))
    return f.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("filled"), 6).alias("completeness"), F.count_if(F.col("filled") < 0.5).alias("errors"), F.count_if((F.col("filled") >= 0.5) & (F.col("filled") < 0.8)).alias("warnings"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS deviation, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def length_baseline(spark: SparkSession, d: str) -> DataFrame:
    return stats.baseline(table(spark, d, "documents"), "source", "n_chars", 4)


@query("SELECT event_id, least(power(2, event_id % 9), 60)::INTEGER AS wait_minutes, event_id % 9 < 5 AND ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events) AS retry FROM events WHERE event_type = 'error'")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Failed rows with the wait before they are tried again (doubled each time, an hour at most), and whether they still are: five times, for seven days."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    tries = F.pmod("event_id", F.lit(9))
    return stats.retries(e.filter("event_type = 'error'").withColumn("tries", tries).join(F.broadcast(now)), "tries", "ts", "now").select("event_id", "wait_minutes", "retry")


def _limits_sql(allowed: str, held: str) -> str:
    """Recursion over a user's events: allowed says whether the next one is, by the times held and its own, t; held is what stays of them."""
    return (
        "WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE ts IS NOT NULL), "
        "f AS (SELECT event_id, user_id, r, true AS ok, [t] AS held FROM o WHERE r = 1 UNION ALL "
        f"SELECT event_id, user_id, r, {allowed} AS ok, CASE WHEN {allowed} THEN list_append(old, t) ELSE old END AS held FROM (SELECT o.*, {held} AS old FROM f JOIN o ON o.user_id IS NOT DISTINCT FROM f.user_id AND o.r = f.r + 1)) "
        "SELECT event_id, user_id FROM f WHERE NOT ok"
    )


MOST_EVENTS, PERIOD = 2, 24 * 3600 * 1_000_000


@query(_limits_sql(f"len(old) < {MOST_EVENTS}", f"[x FOR x IN held IF x > o.t - {PERIOD}]"))
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """A user's events beyond two allowed ones in the day that ends with them; refused ones don't count."""
    ship(spark)
    e = table(spark, d, "events").filter("ts is not null").select("event_id", "user_id", "ts")
    return folds.decided(e, ["user_id"], "ts", "event_id", lambda: folds.Rate(MOST_EVENTS, PERIOD)).filter("not allowed").select("event_id", "user_id")


@query(_limits_sql(f"len(old) < {MOST_EVENTS}", f"CASE WHEN o.t >= held[1] + {PERIOD} THEN [] ELSE held END"))
def calls_over_limit(spark: SparkSession, d: str) -> DataFrame:
    """A user's events beyond two in a day that the first of them opens."""
    ship(spark)
    e = table(spark, d, "events").filter("ts is not null").select("event_id", "user_id", "ts")
    return folds.decided(e, ["user_id"], "ts", "event_id", lambda: folds.Calls(MOST_EVENTS, PERIOD)).filter("not allowed").select("event_id", "user_id")


@query("SELECT o_orderkey, round(0.4 * least(o_totalprice / 500000, 1) + 0.3 * (o_custkey % 100) / 100 + 0.3 * (o_orderkey % 7) / 7, 6) AS risk, CASE WHEN 0.4 * least(o_totalprice / 500000, 1) + 0.3 * (o_custkey % 100) / 100 + 0.3 * (o_orderkey % 7) / 7 >= 0.75 THEN 'CRITICAL' WHEN 0.4 * least(o_totalprice / 500000, 1) + 0.3 * (o_custkey % 100) / 100 + 0.3 * (o_orderkey % 7) / 7 >= 0.5 THEN 'HIGH' WHEN 0.4 * least(o_totalprice / 500000, 1) + 0.3 * (o_custkey % 100) / 100 + 0.3 * (o_orderkey % 7) / 7 >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM orders")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.functions import scores as S

    risk = S.weighted([(F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), 0.4), (F.pmod("o_custkey", F.lit(100)) / 100, 0.3), (F.pmod("o_orderkey", F.lit(7)) / 7, 0.3)])
    return table(spark, d, "orders").select("o_orderkey", F.round(risk, 6).alias("risk"), S.level(risk, [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MEDIUM")], "LOW").alias("level"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS gazette, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS effective, strftime(o_orderdate::DATE - 7, '%Y-%m-%d') AS last_week, year(o_orderdate) BETWEEN 1923 AND 2030 AS plausible, strftime(o_orderdate, '%d.%m.%Y') || ' and ' || strftime(o_orderdate::DATE + 5, '%-d/%-m/%Y') AS found FROM orders")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Dates written out, moved by delays and phrases, and found again in a text."""
    from corpusmill.functions import checks, dates

    day = F.to_date("o_orderdate")
    said = F.concat(F.lit("of "), dates.gazette(day), F.lit(" and "), F.date_format(F.date_add(day, 5), "d/M/yyyy"), F.lit("."))
    return table(spark, d, "orders").select(
        "o_orderkey", dates.gazette(day).alias("gazette"), F.date_format(F.date_add(day, checks.delay_days(F.lit("1 ay sonra"))), "yyyy-MM-dd").alias("effective"),
        F.date_format(checks.relative_date(F.lit(" Geçen hafta"), day), "yyyy-MM-dd").alias("last_week"), F.year(day).between(1923, 2030).alias("plausible"), F.array_join(dates.mentions(said), " and ").alias("found"),
    )


@query("SELECT user_id, round(avg(value), 6) AS mean, list_sort(list(value))[(least(floor(count(value) * 0.95), count(value) - 1) + 1)::BIGINT] AS p95, max(value) > 2 * list_sort(list(value))[(least(floor(count(value) * 0.95), count(value) - 1) + 1)::BIGINT] AS slow, count(*) FILTER (event_type = 'error') > 0.05 * count(*) AS failing FROM events GROUP BY user_id HAVING count(*) >= 10")
def monitor_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Keys of ten rows and more: the largest over twice the 95th percentile, or over 5 % errors."""
    e = table(spark, d, "events")
    p = stats.nearest_rank(e, "user_id", "value", {"p95": 0.95}).withColumnRenamed("user_id", "k_")
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.count_if(F.col("event_type") == "error").alias("errors")).filter("n >= 10")
    return s.join(p, F.col("user_id").eqNullSafe(F.col("k_")), "left").select("user_id", F.round("mean", 6).alias("mean"), "p95", (F.col("most") > 2 * F.col("p95")).alias("slow"), (F.col("errors") > 0.05 * F.col("n")).alias("failing"))


@query(
    "WITH RECURSIVE s AS (SELECT l_suppkey AS k, row_number() OVER o AS n, avg(l_discount * 10 - l_tax * 10) OVER w AS e, avg((l_discount * 10 - l_tax * 10) * (l_discount * 10 - l_tax * 10)) OVER w AS mse FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL "
    "WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax), w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)), c AS (SELECT k, n // 10 AS version, e, mse FROM s WHERE n % 10 = 0), "
    "f AS (SELECT DISTINCT k, 0::BIGINT AS version, 0.0::DOUBLE AS e, 0.0::DOUBLE AS mse, 0.4::DOUBLE AS h, 0.3::DOUBLE AS r, 0.3::DOUBLE AS z FROM c UNION ALL SELECT k, version, e, mse, h / (h + r + z), r / (h + r + z), z / (h + r + z) FROM (SELECT c.k, c.version, c.e, c.mse, greatest(0.1, least(0.7, f.h - c.e * 0.01)) AS h, greatest(0.1, least(0.5, f.r - c.e * 0.0075)) AS r, greatest(0.1, least(0.5, f.z - c.e * 0.0075)) AS z FROM f JOIN c ON c.k IS NOT DISTINCT FROM f.k AND c.version = f.version + 1)) "
    "SELECT k AS l_suppkey, version, round(e, 6) + 0.0 AS mean_error, round(mse, 6) AS mse, round(h, 6) AS hallucination, round(r, 6) AS rag_quality, round(z, 6) AS reasoning FROM f WHERE version > 0"
)
def learned_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by supplier, learnt from discounts as predictions and taxes as truth, ten rows at a time."""
    from corpusmill.operators import learning

    ship(spark)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select("l_suppkey", *order, (F.col("l_discount") * 10).alias("predicted"), (F.col("l_tax") * 10).alias("actual"))
    w = learning.learned(rows, "l_suppkey", order, "predicted", "actual")
    return w.select("l_suppkey", "version", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_error", "mse", *learning.WEIGHTS)])  # no negative zeros
