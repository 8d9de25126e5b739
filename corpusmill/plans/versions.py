"""Versions of documents: differences, patches, articles matched across versions. The later version of a text is made from it line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import differences
from corpusmill.operators import snapshots, versions
from corpusmill.plans.registry import query
from corpusmill.session import ship, table


def _later(x: Column, doc_id: Column) -> Column:
    """Of every thirteen lines one is dropped, one gets a word more and one is followed by a new one."""

    def line(v: Column, i: Column) -> Column:
        lot = F.pmod(doc_id + i + 1, F.lit(13))
        more = F.concat(F.lit("added "), (i + 1).cast("string"))
        return F.when(lot == 0, F.slice(F.array(v), 1, 0)).when(lot == 3, F.array(F.concat(F.lit("x "), v))).when(lot == 5, F.array(v, more)).otherwise(F.array(v))

    return F.array_join(F.flatten(F.transform(F.split(x, "\n"), line)), "\n")


def _both(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null and doc_id is not null")
    return docs.select("doc_id", F.col("text").alias("old"), _later(F.col("text"), F.col("doc_id")).alias("new"))


@query()
def text_changes(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of two versions and the edits between them, character by character. The tests hold it against difflib."""
    ship(spark)
    e = F.col("edits")
    n = lambda op: F.size(F.filter(e, lambda x: x["op"] == op)).alias(f"n_{op}")
    said = F.md5(F.array_join(F.transform(e, lambda x: F.concat_ws("|", x["op"], x["old"], x["new"])), "\n"))
    # both from one comparison, which is not to be run once for each
    rows = _both(spark, d).select("doc_id", differences.changes(F.col("old"), F.col("new")).alias("c")).select("doc_id", "c.ratio", "c.edits")
    return rows.select("doc_id", F.round("ratio", 9).alias("ratio"), n("replace"), n("delete"), n("insert"), said.alias("edits_md5"))


@query()
def patch_hunks(spark: SparkSession, d: str) -> DataFrame:
    """The hunks of lines that lead from one version to the next. The tests hold it against a plain loop."""
    ship(spark)
    rows = _both(spark, d).select("doc_id", F.posexplode(differences.hunks(F.col("old"), F.col("new"))).alias("hunk", "h"))
    return rows.select("doc_id", "hunk", "h.op", "h.old_start", F.size("h.old").alias("old_count"), "h.new_start", F.size("h.new").alias("new_count"), F.md5(F.array_join("h.old", "\n")).alias("old_md5"), F.md5(F.array_join("h.new", "\n")).alias("new_md5"))


_LATER = "array_to_string(flatten([CASE (doc_id + i) % 13 WHEN 0 THEN [] WHEN 3 THEN ['x ' || l[i]] WHEN 5 THEN [l[i], 'added ' || i] ELSE [l[i]] END FOR i IN range(1, len(l) + 1)]), chr(10))"


@query(
    f"SELECT doc_id, md5({_LATER}) AS patched_md5, md5(text) AS restored_md5, 0 AS conflicts, ({_LATER} <> text) AS changed FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
)
def patched_texts(spark: SparkSession, d: str) -> DataFrame:
    """A patch applied to the text that it was made from, and its reverse to the result."""
    ship(spark)
    made = _both(spark, d).select("doc_id", "old", differences.hunks(F.col("old"), F.col("new")).alias("patch"))
    there = made.select("doc_id", "old", "patch", differences.patched(F.col("old"), F.col("patch")).alias("there"))
    back = there.select("doc_id", "patch", "there", differences.patched(F.col("there.text"), differences.reverse(F.col("patch"))).alias("back"))
    conflicts = F.size("there.conflicts") + F.size("back.conflicts")
    return back.select("doc_id", F.md5("there.text").alias("patched_md5"), F.md5("back.text").alias("restored_md5"), conflicts.alias("conflicts"), (F.size("patch") > 0).alias("changed"))


def articles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as articles, in two versions: of every six one is dropped, one gets another number and is changed, one is changed."""
    docs = table(spark, d, "documents").filter("text is not null and doc_id is not null")
    old = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "content")).filter("trim(content) <> ''")
    lot = F.pmod(F.xxhash64("doc_id", "n"), F.lit(6))
    number = F.when(lot == 1, F.concat(F.lit("new "), (F.col("n") + 100).cast("string"))).otherwise(F.col("n").cast("string"))
    content = F.when(lot <= 2, F.concat(F.expr("substr(content, 4)"), F.lit(" again"))).otherwise(F.col("content"))
    new = old.filter(lot != 0).select("doc_id", number.alias("number"), F.lit(None).cast("string").alias("title"), content.alias("content"))
    return old.select("doc_id", F.col("n").cast("string").alias("number"), F.lit(None).cast("string").alias("title"), "content"), new


@query()
def article_matches(spark: SparkSession, d: str) -> DataFrame:
    """Articles of two versions matched one to one. The tests hold it against a plain greedy loop."""
    ship(spark)
    old, new = articles(spark, d)
    found = versions.match_articles(old, new, "doc_id")
    return found.withColumn("likeness", F.round("likeness", 9))


#: Versions of a partition, about: memory of a task stays the same as records grow in number.
PART = 25_000


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A customer's record at each order: what the order says, its price class only above a threshold."""
    o = table(spark, d, "orders").filter("o_custkey is not null and o_orderkey is not null")
    state = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("level"), F.year("o_orderdate").cast("string").alias("year")).alias("order"))
    rows = snapshots.paths(o.select("o_custkey", "o_orderkey", state.alias("state")), ["o_custkey", "o_orderkey"], "state")
    high = o.filter("o_totalprice > 100000").select("o_custkey", "o_orderkey", F.lit("price.high").alias("path"), F.floor(F.col("o_totalprice") / 100000).cast("string").alias("value"))
    return rows.unionByName(high)


@query(
    "SELECT o_orderkey, o_custkey, md5(CASE WHEN o_totalprice > 100000 THEN concat_ws(chr(10), 'order.level=' || o_orderpriority, 'order.year=' || year(o_orderdate), 'price.high=' || floor(o_totalprice / 100000)::BIGINT, 'status=' || o_orderstatus) "
    "ELSE concat_ws(chr(10), 'order.level=' || o_orderpriority, 'order.year=' || year(o_orderdate), 'status=' || o_orderstatus) END) AS state_md5 FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL"
)
def restored_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every customer's record, restored from full snapshots and deltas."""
    records = _records(spark, d)
    orders = table(spark, d, "orders").filter("o_custkey is not null and o_orderkey is not null").select("o_custkey", "o_orderkey")
    parts = 1 + orders.count() // PART
    back = snapshots.restore(snapshots.deltas(records, "o_custkey", "o_orderkey", 5, parts), orders, "o_custkey", "o_orderkey", parts).repartition(parts, "o_orderkey", "o_custkey")
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "path", "value"))), "\n")
    return back.groupBy("o_orderkey", "o_custkey").agg(F.md5(lines).alias("state_md5"))
