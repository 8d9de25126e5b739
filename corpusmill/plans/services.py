"""Filters, access, joins and statistics of the services, over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import dates, text
from corpusmill.operators import audit, filters
from corpusmill.plans.registry import query
from corpusmill.session import ship, table


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderdate IS NULL OR (o_orderdate >= '1996-01-01' AND o_orderdate <= '1998-12-31')) AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 AND o_custkey % 10 = 3")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    """Optional conditions joined by and: range with missing dates let through, membership, least score, equality."""
    some = [filters.within(F.col("o_orderdate"), "1996-01-01", "1998-12-31"), filters.condition("o_orderstatus", "in", ["F", "O"]), filters.condition("o_totalprice", "gte", 100000), F.pmod("o_custkey", F.lit(10)) == 3, None]
    return table(spark, d, "orders").filter(filters.every(some)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'login') OR value > 150")
def security_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("error", "login") | (F.col("value") > 150)).select("event_id", "event_type")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%auto%') AND c_acctbal > 0) AS total, (SELECT ceil(count(*) / 25)::BIGINT FROM customer WHERE (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%auto%') AND c_acctbal > 0) AS pages, (SELECT count(*) > 50 FROM customer WHERE (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%auto%') AND c_acctbal > 0) AS has_next FROM customer WHERE (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%auto%') AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def user_search(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").filter(filters.found_in("7", F.col("c_name")) | filters.found_in("auto", F.col("c_mktsegment"))).filter("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    return filters.page_of(found, [F.desc("c_acctbal"), F.col("c_custkey")], 2, 25).drop("c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def row_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(filters.may_see(F.col("o_custkey"), 7, F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= (SELECT max(o_orderdate)::DATE - 90 FROM orders) AND 5 - substr(o_orderpriority, 1, 1)::INT >= 3 AND o_orderstatus = 'F'")
def recent_updates(spark: SparkSession, d: str) -> DataFrame:
    """The last 90 days before the newest row, of at least an ordinal impact."""
    o = table(spark, d, "orders")
    newest = o.agg(F.date_sub(F.to_date(F.max("o_orderdate")), 90).alias("since"))  # one row
    impact = F.create_map(*[F.lit(x) for p, n in (("1-URGENT", 4), ("2-HIGH", 3), ("3-MEDIUM", 2), ("4-NOT SPECIFIED", 1), ("5-LOW", 0)) for x in (p, n)])
    return o.join(F.broadcast(newest)).filter((F.to_date("o_orderdate") >= F.col("since")) & (F.try_element_at(impact, F.col("o_orderpriority")) >= 3) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate::DATE + 30 < DATE '1998-01-01' AND o_orderstatus <> 'F' AS overdue, o_orderdate + INTERVAL 72 HOUR < TIMESTAMP '1998-01-01' AS late_notice FROM orders")
def overdue_flags(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("1998-01-01").cast("date")
    overdue = (F.date_add(F.to_date("o_orderdate"), 30) < as_of) & (F.col("o_orderstatus") != "F")
    return table(spark, d, "orders").select("o_orderkey", overdue.alias("overdue"), (F.col("o_orderdate") + F.expr("INTERVAL 72 HOURS") < as_of.cast("timestamp_ntz")).alias("late_notice"))


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'widget']) AS any_tag, list_has_all(string_split(p_name, ' '), ['red', 'widget']) AS all_tags FROM part WHERE p_size >= 20")
def tag_filters(spark: SparkSession, d: str) -> DataFrame:
    tags = F.split("p_name", " ")
    return table(spark, d, "part").filter("p_size >= 20").select("p_partkey", filters.any_of(tags, ["red", "widget"]).alias("any_tag"), filters.all_of(tags, ["red", "widget"]).alias("all_tags"))


@query("SELECT event_id, user_id % 50 = 0 OR (hour(ts) BETWEEN 9 AND 17 AND coalesce('10.0.0.' || (user_id % 4) IN ('10.0.0.1', '10.0.0.2'), false) AND value < 100) AS allowed FROM events")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    address = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(4)))
    policies = [filters.in_business_hours(F.col("ts")), filters.listed(address, ["10.0.0.1", "10.0.0.2"]), filters.listed(address, None), F.col("value") < 100]
    return table(spark, d, "events").select("event_id", filters.decide(F.pmod("user_id", F.lit(50)) == 0, policies).alias("allowed"))


_OPS = [("c_custkey", "eq", 5), ("c_custkey", "ne", 5), ("c_acctbal", "gt", 500.0), ("c_acctbal", "lt", 500.0), ("c_acctbal", "gte", 0.0), ("c_acctbal", "lte", 0.0), ("c_mktsegment", "in", ["BUILDING"]), ("c_mktsegment", "not_in", ["BUILDING"]), ("c_name", "contains", "99"), ("c_name", "matches", "0[13]$")]


@query("SELECT c_custkey, (c_custkey = 5)::INT + (c_custkey <> 5)::INT * 2 + (c_acctbal > 500)::INT * 4 + (c_acctbal < 500)::INT * 8 + (c_acctbal >= 0)::INT * 16 + (c_acctbal <= 0)::INT * 32 + (c_mktsegment = 'BUILDING')::INT * 64 + (c_mktsegment <> 'BUILDING')::INT * 128 + contains(c_name, '99')::INT * 256 + regexp_matches(c_name, '0[13]$')::INT * 512 AS bits FROM customer")
def condition_bits(spark: SparkSession, d: str) -> DataFrame:
    bits = [filters.condition(*c).cast("int") * (1 << i) for i, c in enumerate(_OPS)]
    return table(spark, d, "customer").select("c_custkey", sum(bits[1:], bits[0]).alias("bits"))


@query("WITH s AS (SELECT c_custkey, ('0x' || substr(sha256('layout:' || c_custkey), 1, 8))::BIGINT % 10000 / 10000 AS share FROM customer) SELECT c_custkey, CASE WHEN share < 0.5 THEN 'a' WHEN share < 0.8 THEN 'b' WHEN share < 0.9 THEN 'c' END AS variant, c_custkey IN (1, 2, 3) OR share < 0.1 AS is_on FROM s")
def flag_variants(spark: SparkSession, d: str) -> DataFrame:
    share = text.rollout(F.col("c_custkey"), "layout")
    return table(spark, d, "customer").select("c_custkey", filters.variant(share, {"a": 0.5, "b": 0.3, "c": 0.1}).alias("variant"), (F.col("c_custkey").isin(1, 2, 3) | (share < 0.1)).alias("is_on"))


@query("SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_shipdate < o_orderdate THEN 'shipped before order' END, CASE WHEN l_shipdate > o_orderdate + INTERVAL 121 DAY THEN 'shipped late' END, CASE WHEN year(l_shipdate) NOT BETWEEN 1992 AND 1998 THEN 'out of range' END], lambda x: x IS NOT NULL).list_aggregate('string_agg', '; ') AS issues FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Dates that must follow each other, stay near and lie in a range; a list of what fails."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    issues = dates.issues(
        {
            "shipped before order": F.col("l_shipdate") < F.col("o_orderdate"),
            "shipped late": F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 121 DAYS"),
            "out of range": ~F.year("l_shipdate").between(1992, 1998),
        }
    )
    return rows.select("l_orderkey", "l_linenumber", F.when(F.size(issues) > 0, F.array_join(issues, "; ")).alias("issues"))


@query("SELECT DISTINCT p_type, contains(p_type, '*') AS wildcard FROM part")
def resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_type", F.contains("p_type", F.lit("*")).alias("wildcard")).distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1998-06-01')")
def consents(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a granted consent that has not run out."""
    valid = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS") > F.lit("1998-06-01").cast("timestamp_ntz")))
    return table(spark, d, "customer").join(valid.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal IS NULL OR c_acctbal > 100")
def unexpired_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal is null or c_acctbal > 100").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


_MISSING = "SELECT l_orderkey + 40 * l_linenumber AS k, l_linenumber FROM lineitem WHERE l_linenumber >= 6"


@query(f"WITH r AS ({_MISSING}), m AS (SELECT DISTINCT k FROM r WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)), o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT k AS missing, arg_min(o_orderkey, abs(o_orderkey - k) * 2 + (o_orderkey > k)::INT) AS nearest FROM m LEFT JOIN o ON abs(o_orderkey - k) <= 100000000 GROUP BY k")
def broken_references(spark: SparkSession, d: str) -> DataFrame:
    """Targets that do not exist, with the nearest one that does (the lower of two): the last before and the first after, within blocks and between them."""
    from corpusmill.operators import joins

    cited = table(spark, d, "lineitem").filter("l_linenumber >= 6").select((F.col("l_orderkey") + 40 * F.col("l_linenumber")).alias("k")).distinct()
    known = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    missing = cited.join(known, "k", "left_anti")
    return joins.nearest_number(missing, known, "k").select(F.col("k").alias("missing"), "nearest")


@query("SELECT i % 25 AS tenant, 'event ' || event_type AS said, event_id FROM (SELECT *, user_id % 25 AS i FROM events) WHERE (event_type = 'purchase' AND value > 50) OR (event_type = 'error' AND user_id % 25 = 3)")
def triggered(spark: SparkSession, d: str) -> DataFrame:
    """Events that meet a trigger: same name, its tenant none or the event's, its least value none or reached."""
    triggers = spark.createDataFrame([("purchase", None, 50.0), ("error", 3, None)], "name string, of_tenant long, above double")
    e = table(spark, d, "events").withColumn("tenant", F.pmod("user_id", F.lit(25)))
    fits = (F.col("event_type") == F.col("name")) & (F.col("of_tenant").isNull() | (F.col("of_tenant") == F.col("tenant"))) & (F.col("above").isNull() | (F.col("value") > F.col("above")))
    return e.join(F.broadcast(triggers), fits).select("tenant", F.concat(F.lit("event "), F.col("event_type")).alias("said"), "event_id")


@query("WITH last AS (SELECT c_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT count(*) AS policies, count(*) FILTER (status = 'F') AS compliant, count(*) FILTER (status = 'O') AS partial, count(*) FILTER (status IS NULL) AS unchecked, round(100.0 * count(*) FILTER (status = 'F') / count(*), 2) AS rate FROM last")
def compliance_status(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    all_ = table(spark, d, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return all_.agg(F.count("*").alias("policies"), F.count_if(F.col("status") == "F").alias("compliant"), F.count_if(F.col("status") == "O").alias("partial"), F.count_if(F.col("status").isNull()).alias("unchecked"), F.round(100.0 * F.count_if(F.col("status") == "F") / F.count("*"), 2).alias("rate"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'tenant' WHEN c_mktsegment = 'BUILDING' THEN 'strict' WHEN n_regionkey = 1 THEN 'regional' ELSE 'standard' END AS level FROM customer JOIN nation ON c_nationkey = n_nationkey")
def layered_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The most specific setting: of the tenant, else of its sector, else of its region, else the standard."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tenants = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("t_key"), F.lit("tenant").alias("t_level"))
    sectors = spark.createDataFrame([("BUILDING", "strict")], "s_key string, s_level string")
    regions = spark.createDataFrame([(1, "regional")], "r_key int, r_level string")
    met = c.join(tenants, F.col("c_custkey") == F.col("t_key"), "left").join(F.broadcast(sectors), F.col("c_mktsegment") == F.col("s_key"), "left").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_key"), "left")
    return met.select("c_custkey", F.coalesce("t_level", "s_level", "r_level", F.lit("standard")).alias("level"))


@query("SELECT t.kind, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM events), 2) AS share FROM (SELECT unnest(['click', 'view', 'purchase', 'error', 'refund']) AS kind) t LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON kind = event_type")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "error", "refund")], "kind string")
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    filled = F.coalesce("n", F.lit(0))
    return kinds.join(n, "kind", "left").join(F.broadcast(total)).select("kind", filled.alias("n"), F.round(filled * 100.0 / F.col("total"), 2).alias("share"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last, max(event_id) + 1 AS next FROM events GROUP BY user_id")
def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return audit.next_sequence(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id")
def current_states(spark: SparkSession, d: str) -> DataFrame:
    return audit.current_state(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT month, n, round(total, 2) AS total, round(total / n, 2) AS mean, trend FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1), (SELECT CASE WHEN arg_max(n, month) > arg_min(n, month) THEN 'up' WHEN arg_max(n, month) < arg_min(n, month) THEN 'down' ELSE 'flat' END AS trend FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1))")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    ends = by.agg(F.max_by("n", "month").alias("z"), F.min_by("n", "month").alias("a"))  # one row
    trend = F.when(F.col("z") > F.col("a"), "up").when(F.col("z") < F.col("a"), "down").otherwise("flat")
    return by.join(F.broadcast(ends)).select("month", "n", F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("n"), 2).alias("mean"), trend.alias("trend"))


@query("SELECT l_returnflag AS status, CASE WHEN l_discount > 0.09 THEN 'high' WHEN l_discount > 0.07 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(l_discount), 6) AS mean, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 2) AS success FROM lineitem GROUP BY ALL")
def review_bands(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_discount")
    band = F.when(c > 0.09, "high").when(c > 0.07, "medium").otherwise("low")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("status"), band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(100.0 * F.count_if(F.col("l_linestatus") == "F") / F.count("*"), 2).alias("success"))


@query("SELECT tag, count(*) AS n, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag")
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT l_partkey, (count(*) FILTER (l_quantity >= 40) - count(*) FILTER (l_quantity <= 5))::BIGINT AS votes FROM lineitem GROUP BY l_partkey")
def vote_scores(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg((F.count_if(q >= 40) - F.count_if(q <= 5)).alias("votes"))


@query("SELECT round(avg(abs(a - b)), 6) AS mae, round(avg((a - b) ** 2), 6) AS mse, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(corr(a, b), 6) AS pearson FROM (SELECT l_quantity / 50 AS a, l_extendedprice / 100000 AS b FROM lineitem)")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"))
    err = F.col("a") - F.col("b")
    return p.agg(F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.avg(err * err), 6).alias("mse"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse"), F.round(F.corr("a", "b"), 6).alias("pearson"))


@query("WITH c AS (SELECT l_returnflag AS kind, l_suppkey AS item, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fp, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS fn FROM lineitem GROUP BY ALL), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c) SELECT kind, count(*) AS cases, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM m GROUP BY kind")
def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean precision, recall and F1 of cases, by kind."""
    real, said = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_suppkey").agg(F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    m = c.withColumns({"p": part("tp", "fp"), "r": part("tp", "fn")})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return m.groupBy("kind").agg(F.count("*").alias("cases"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(f1), 6).alias("f1"))


@query("SELECT topic, sum(w) AS weight, count(*) AS n FROM (SELECT string_split(p_name, ' ')[1] AS topic, 1.0::DOUBLE AS w FROM part UNION ALL SELECT string_split(p_name, ' ')[2], 0.5 FROM part) WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) >= 2")
def topic_trends(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    votes = F.array(F.struct(F.get(words, 0).alias("topic"), F.lit(1.0).alias("w")), F.struct(F.get(words, 1).alias("topic"), F.lit(0.5).alias("w")))
    return table(spark, d, "part").select(F.inline(votes)).filter("topic is not null").groupBy("topic").agg(F.sum("w").alias("weight"), F.count("*").alias("n")).filter("n >= 2")


@query("WITH j AS (SELECT o_orderkey, o_orderpriority AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END * 100 - least(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') / 10.0, 50) - CASE WHEN o_totalprice > 400000 THEN 20 ELSE 0 END AS score, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS wait FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY p ORDER BY score) AS place FROM j) SELECT p AS priority, count(*) AS n, round(avg(wait), 4) AS mean_wait, max(wait)::BIGINT AS longest_wait, count(*) FILTER (wait > 2000) AS violations, round(min(score), 4) AS best, max(place) AS places FROM r GROUP BY p")
def queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Priority scores (base, waiting, tier), places within a priority, waits and limits exceeded."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")) for x in (p, i + 1)]), F.col("o_orderpriority"))
    wait = F.date_diff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    score = F.coalesce(base, F.lit(5)) * 100 - F.least(wait / 10.0, F.lit(50.0)) - F.when(F.col("o_totalprice") > 400000, 20).otherwise(0)
    j = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), score.alias("score"), wait.alias("wait"))
    # the last place of a priority is one more than the rows below its highest score
    top = j.groupBy("priority").agg(F.max("score").alias("top"))
    below = j.join(F.broadcast(top), "priority").groupBy("priority").agg((F.count_if(F.col("score") < F.col("top")) + 1).alias("places"))
    stats = j.groupBy("priority").agg(F.count("*").alias("n"), F.round(F.avg("wait"), 4).alias("mean_wait"), F.max("wait").cast("long").alias("longest_wait"), F.count_if(F.col("wait") > 2000).alias("violations"), F.round(F.min("score"), 4).alias("best"))
    return stats.join(below, "priority")


@query("WITH c AS (SELECT l_suppkey % 5 AS chamber, year(l_shipdate) AS y, l_returnflag = 'A' AS support FROM lineitem), m AS (SELECT max(y) AS last FROM c) SELECT chamber, count(*) AS n, round(100.0 * count(*) FILTER (support) / count(*), 2) AS support, round(count(*) FILTER (support AND y >= last - 2) / count(*) FILTER (y >= last - 2) - count(*) FILTER (support AND y < last - 2) / count(*) FILTER (y < last - 2), 6) AS shift, round((least(count(*) / 20, 1) + least(count(DISTINCT y) / 5, 1)) / 2, 6) AS coverage FROM c, m GROUP BY chamber")
def outcome_trends(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(5)).alias("chamber"), F.year("l_shipdate").alias("y"), (F.col("l_returnflag") == "A").alias("support"))
    last = c.agg(F.max("y").alias("last"))  # one row
    new = F.col("y") >= F.col("last") - 2
    share = lambda when: F.count_if(F.col("support") & when) / F.count_if(when)
    return (
        c.join(F.broadcast(last))
        .groupBy("chamber")
        .agg(F.count("*").alias("n"), F.round(100.0 * F.count_if("support") / F.count("*"), 2).alias("support"), F.round(share(new) - share(~new), 6).alias("shift"), F.round((F.least(F.count("*") / 20, F.lit(1.0)) + F.least(F.count_distinct("y") / 5, F.lit(1.0))) / 2, 6).alias("coverage"))
    )


@query("SELECT count(*) AS expired FROM orders WHERE o_orderdate::DATE < (SELECT max(o_orderdate)::DATE - 1825 FROM orders)")
def expired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows older than the longer of two retention periods."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    cutoff = o.agg(F.date_sub(F.max("day"), F.greatest(F.lit(365), F.lit(1825))).alias("cutoff"))  # one row
    return o.join(F.broadcast(cutoff)).filter("day < cutoff").agg(F.count("*").alias("expired"))


@query("WITH s AS (SELECT event_id, user_id, ts, event_type, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT *, n + (event_id % 53 = 0)::INT * 7 AS seq, CASE WHEN event_id % 41 = 0 THEN 'x' ELSE '' END || sha256(user_id || '|' || event_id || '|' || event_type) AS hash FROM s), p AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN 'y' ELSE coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY n), repeat('0', 64)) END AS prev FROM h), o AS (SELECT *, coalesce(lag(seq) OVER q, 0) AS seq0, coalesce(lag(hash) OVER q, repeat('0', 64)) AS hash0, lag(ts) OVER q AS ts0 FROM p WINDOW q AS (PARTITION BY user_id ORDER BY seq, event_id)) SELECT event_id, v AS violation FROM (SELECT event_id, unnest([CASE WHEN hash <> sha256(user_id || '|' || event_id || '|' || event_type) THEN 'hash_mismatch' END, CASE WHEN seq <> seq0 + 1 THEN 'chain_gap' END, CASE WHEN prev IS DISTINCT FROM hash0 THEN 'previous_mismatch' END, CASE WHEN ts < ts0 THEN 'time_reversed' END]) AS v FROM o) WHERE v IS NOT NULL")
def chain_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events as a chain for each user, with hashes, links and numbers tampered with here and there."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    hit = lambda n: F.pmod("event_id", F.lit(n)) == 0
    expected = audit.event_hash(F.col("user_id"), F.col("event_id"), F.col("event_type"))
    e = table(spark, d, "events").withColumn("n", F.row_number().over(w)).withColumn("hash", F.concat(F.when(hit(41), "x").otherwise(""), expected))
    e = e.withColumn("prev", F.when(hit(37), "y").otherwise(F.coalesce(F.lag("hash").over(w), F.lit(audit.GENESIS)))).withColumn("seq", F.struct((F.col("n") + F.when(hit(53), 7).otherwise(0)).alias("s"), "event_id"))
    plain = e.withColumn("seq_no", F.col("seq.s"))
    # rows with one number follow each other by id
    order = W.partitionBy("user_id").orderBy("seq_no", "event_id")
    numbered = plain.withColumns({"seq0": F.coalesce(F.lag("seq_no").over(order), F.lit(0)), "place": F.row_number().over(order)})
    gaps = numbered.filter("seq_no <> seq0 + 1").select("event_id", F.lit("chain_gap").alias("violation"))
    rest = audit.verify_chain(numbered, "user_id", "place", "ts", "hash", "prev", expected).select("event_id", "violation")
    return rest.filter("violation <> 'chain_gap'").unionByName(gaps)


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, event_type, n, t AS last, event_id, true AS sent FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN e.t - f.last >= 3600000000 THEN e.t ELSE f.last END, e.event_id, e.t - f.last >= 3600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1) SELECT event_id, event_type FROM f WHERE sent")
def alerts_after_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """An alert that is sent silences its key for an hour; silenced ones do not."""
    ship(spark)
    return audit.alerts(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600).select("event_id", "event_type")


@query("SELECT src, dst, max(kind) AS kind, count(*) AS times FROM (SELECT 'o' || l_orderkey AS src, coalesce('p' || nullif(l_partkey, 0), 'line' || l_linenumber) AS dst, CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'R' THEN 'REPEALS' ELSE 'CITES' END AS kind FROM lineitem) GROUP BY src, dst, kind")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a type, unknown ones as CITES, each once; a missing target falls back to the row's own number."""
    kind = F.coalesce(F.try_element_at(F.create_map(F.lit("A"), F.lit("AMENDS"), F.lit("R"), F.lit("REPEALS")), F.col("l_returnflag")), F.lit("CITES"))
    dst = F.coalesce(F.when(F.col("l_partkey") != 0, F.concat(F.lit("p"), F.col("l_partkey"))), F.concat(F.lit("line"), F.col("l_linenumber")))
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), dst.alias("dst"), kind.alias("kind"))
    return rows.groupBy("src", "dst", "kind").agg(F.count("*").alias("times"))


@query("SELECT conv_id, turn, gap_before, repeated FROM (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS gap_before, count(*) OVER (PARTITION BY conv_id, turn) AS repeated FROM conversations) WHERE gap_before > 1 OR repeated > 1 OR turn < 0")
def numbering_issues(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, repeats and invalid numbers in a sequence."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    seen = table(spark, d, "conversations").withColumns({"gap_before": F.col("turn") - F.lag("turn").over(w), "repeated": F.count("*").over(W.partitionBy("conv_id", "turn"))})
    return seen.filter("gap_before > 1 or repeated > 1 or turn < 0").select("conv_id", "turn", "gap_before", "repeated")


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM (SELECT * FROM events WHERE user_id < 20 UNION ALL SELECT * FROM events WHERE user_id % 3 = 0) WHERE event_id IN (SELECT event_id FROM events WHERE value > 10) GROUP BY event_type")
def merged_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Two timelines as one bag, those of a filtered one kept, with the span of each kind."""
    e = table(spark, d, "events")
    both = e.filter("user_id < 20").unionByName(e.filter("user_id % 3 = 0")).join(e.filter("value > 10").select("event_id"), "event_id", "left_semi")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return both.groupBy("event_type").agg(stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"), F.count("*").alias("n"))


@query("SELECT k, min(field) AS field, count(*) AS n, round(max(m) / max(total), 6) AS modal_share FROM (SELECT 'props' AS field, (event_id % 10)::BIGINT AS k, kind, count(*) OVER (PARTITION BY event_id % 10, kind) AS m, count(*) OVER (PARTITION BY event_id % 10) AS total FROM (SELECT event_id, CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+') THEN 'float' ELSE 'string' END AS kind FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN value::VARCHAR ELSE event_id::VARCHAR END AS v FROM events))) GROUP BY k")
def field_types(spark: SparkSession, d: str) -> DataFrame:
    """The share of a field's most frequent value type."""
    from corpusmill.operators import stats

    r = F.pmod("event_id", F.lit(3))
    v = F.when(r == 0, F.col("event_type")).when(r == 1, F.col("value").cast("string")).otherwise(F.col("event_id").cast("string"))
    rows = table(spark, d, "events").select(F.pmod("event_id", F.lit(10)).alias("k"), F.lit("props").alias("field"), stats.value_type(v).alias("kind"))
    return stats.modal_share(rows, ["k", "field"], "kind")


@query("SELECT o_orderkey, change, round(score, 4) AS score FROM (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS change, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 0.8 WHEN a.v = b.v THEN 0.0 ELSE abs(a.v - b.v) / greatest(a.v, b.v) END AS score FROM (SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k)")
def scored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Versions side by side: added and deleted entries weigh 0.8, modified ones by how far they are apart."""
    side = lambda n: table(spark, d, "lineitem").filter(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias(f"k{n}")).agg(F.max("l_quantity").alias(f"v{n}"))
    met = side(1).join(side(2), F.col("k1") == F.col("k2"), "full")
    one = F.col("k1").isNull() | F.col("k2").isNull()
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "deleted").when(F.col("v1") == F.col("v2"), "unchanged").otherwise("modified")
    score = F.when(one, 0.8).when(F.col("v1") == F.col("v2"), 0.0).otherwise(F.abs(F.col("v1") - F.col("v2")) / F.greatest("v1", "v2"))
    return met.select(F.coalesce("k1", "k2").alias("o_orderkey"), change.alias("change"), F.round(score, 4).alias("score"))
