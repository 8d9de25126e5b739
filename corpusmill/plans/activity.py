"""Usage, audit, monitoring and retention over events, orders, customers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import dates, text
from corpusmill.operators import joins, stats
from corpusmill.plans.registry import query
from corpusmill.session import table

QUARTERS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def usage_by_type_and_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT props, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY props ORDER BY n DESC, props LIMIT 10")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return stats.matching(table(spark, d, "events"), event_type="view").groupBy("props").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "props").limit(10)


@query("SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large, max(event_id) AS last_id FROM events")
def audit_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(
        F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 100).alias("large"), F.max("event_id").alias("last_id")
    )


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id")
def user_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("kinds"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last")
    )


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    return o.groupingSets([["status"], ["priority"], []], "status", "priority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select("status", "priority", "n", "total")


@query(
    "SELECT event_type, "
    + ", ".join(f"list_sort(list(value))[(least(floor(count(value) * {p}), count(value) - 1) + 1)::BIGINT] AS {k}" for k, p in QUARTERS.items())
    + " FROM events WHERE value IS NOT NULL GROUP BY event_type"
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(table(spark, d, "events"), "event_type", "value", QUARTERS)


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN age < 365 THEN 'hot' WHEN age < 1095 THEN 'warm' WHEN age < 1825 THEN 'cold' ELSE 'archive' END AS tier FROM (SELECT date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders)) GROUP BY tier")
def retention_tiers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    age = F.date_diff("last", "day")
    tier = F.when(age < 365, "hot").when(age < 1095, "warm").when(age < 1825, "cold").otherwise("archive")
    return o.join(F.broadcast(o.agg(F.max("day").alias("last")))).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') WHERE recent >= 2")
def failed_threshold_15min(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("second").rangeBetween(-900, 0)
    return stats.matching(table(spark, d, "events"), event_type="error").withColumn("second", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts")).withColumn("recent", F.count("*").over(w)).filter("recent >= 2").select("event_id", "user_id", "recent")


@query("SELECT event_id, event_type, coalesce(click, -1) AS click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click FROM events) WHERE event_type = 'purchase'")
def asof_parent(spark: SparkSession, d: str) -> DataFrame:
    return joins.as_of(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id", "click").filter("event_type = 'purchase'").select("event_id", "event_type", F.coalesce("click", F.lit(-1)).alias("click"))


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL) GROUP BY user_id")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 10.0, 50.0, 100.0, 500.0])::DOUBLE AS le) GROUP BY ALL")
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    les = [1.0, 10.0, 50.0, 100.0, 500.0]
    counts = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).alias(str(int(x))) for x in les])
    return counts.select("event_type", F.inline(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"`{int(x)}`").alias("n")) for x in les])))


@query("SELECT k, count(*) AS n FROM (SELECT (props->>'$.k')::BIGINT AS k FROM events) GROUP BY k")
def json_property_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE contains(lower(props || event_type), '\"k\": 7') AND hour(ts) BETWEEN 9 AND 17")
def searched_in_business_hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.contains(F.lower(F.concat("props", "event_type")), F.lit('"k": 7')) & F.hour("ts").between(9, 17)).select("event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 10")
def last_10_turns(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, d, "conversations").withColumn("r", r).filter("r <= 10").select("conv_id", "turn", "role")


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))


@query("SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT *, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 500")
def token_budget_context(spark: SparkSession, d: str) -> DataFrame:
    return joins.within_budget(table(spark, d, "conversations"), "conv_id", [F.desc("turn"), F.col("role"), F.col("text")], F.floor(F.length("text") / 4), 500).select("conv_id", "turn", "used")


@query("SELECT o_custkey, o_orderkey, gap FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders) WHERE gap > 1000")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - F.col("o_orderkey")
    return table(spark, d, "orders").withColumn("gap", gap).filter("gap > 1000").select("o_custkey", "o_orderkey", "gap")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def legal_hold_anti(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(held, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def privilege_semi(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(cases, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT r_name, n_name, count(*) AS users, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def members_by_scope(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    each = c.groupBy("c_nationkey").agg(F.count("*").alias("users"), F.sum("c_acctbal").alias("balance"))
    return each.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.sum("users").alias("users"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return joins.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey > 100").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


@query("SELECT c_custkey, round(('0x' || substr(sha256('new-search:' || c_custkey), 1, 8))::BIGINT % 10000 / 10000, 6) AS share, ('0x' || substr(sha256('new-search:' || c_custkey), 1, 8))::BIGINT % 10000 / 10000 < 0.25 AS is_on FROM customer")
def rollout_bucket(spark: SparkSession, d: str) -> DataFrame:
    share = text.rollout(F.col("c_custkey"), "new-search")
    return table(spark, d, "customer").select("c_custkey", F.round(share, 6).alias("share"), (share < 0.25).alias("is_on"))


@query("SELECT l_suppkey, round(100.0 * (count(*) FILTER (l_quantity >= 45) - count(*) FILTER (l_quantity <= 10)) / count(*), 2) AS nps FROM lineitem GROUP BY l_suppkey")
def net_promoters(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(100.0 * (F.count_if(q >= 45) - F.count_if(q <= 10)) / F.count("*"), 2).alias("nps"))


@query("SELECT year, sum(n)::BIGINT AS n, round(sum(s), 2) AS total FROM (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY ALL) GROUP BY year")
def yearly_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, strftime((SELECT list_sort([x FOR x IN generate_series(o_orderdate::DATE + 1, o_orderdate::DATE + 21, INTERVAL 1 DAY) IF isodow(x) < 6])[10]), '%Y-%m-%d') AS due FROM orders")
def business_deadline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.add_business_days(F.to_date("o_orderdate"), 10), "yyyy-MM-dd").alias("due"))


@query("SELECT c_custkey, round(score, 6) AS score FROM (SELECT c_custkey, sum(s) AS score FROM (SELECT c_custkey, 0.7 / (60 + r) AS s FROM (SELECT o_custkey AS c_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey) WHERE r <= 100 UNION ALL SELECT c_custkey, 0.3 / (60 + r) FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 100) GROUP BY ALL)")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    def ranked(df: DataFrame, by: str) -> DataFrame:
        # the best hundred are a top-k report, so the window orders a hundred rows
        return df.orderBy(F.desc(by), "c_custkey").limit(100).withColumn("rank", F.row_number().over(W.orderBy(F.desc(by), "c_custkey")))

    often = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    fused = joins.fuse([(ranked(often, "n"), 0.7), (ranked(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"), 0.3)], "c_custkey")
    return fused.withColumn("score", F.round("score", 6))
