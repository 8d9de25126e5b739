"""Line dedup by site-relative frequency.

Documents are grouped by host. A line's frequency is the number of the host's
documents that contain it, over all documents of the host; lines above
`most_share` that at least `least_pages` documents contain are boilerplate and are
dropped from every document of the host. On hosts of fewer documents a line must be
in all of them, and in SMALL_HOST at least. The share bounds the boilerplate of a
host: at most 1/most_share lines for each line of its mean document.

Lines are counted by 64-bit hashes, first within map tasks, so a host with a
third of all documents is summed up before the shuffle; documents meet their
host's boilerplate by host and a salt, or by broadcast when it is small.

Defined results: null texts stay null and count as documents of their host without
lines; empty lines and lines of white space are never boilerplate; a null host is
a host; rows that repeat are separate documents; an empty table gives an empty one;
other columns stay as they are, but for one named n_dropped, which the count replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import durable

MOST_SHARE = 0.02
LEAST_PAGES = 5
#: Hosts of fewer documents have no boilerplate: two copies of one text are not a template.
SMALL_HOST = 3
#: Boilerplate lines broadcast at most; beyond that hosts and documents are joined by a salted key.
BROADCAST_LINES = 200_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, line (hash), pages, host_pages of every boilerplate line."""
    given = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = given.groupBy("host").agg(F.count("*").alias("host_pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    pages = given.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min(least_pages, SMALL_HOST))
    enough = F.col("pages") >= F.least(F.lit(least_pages), F.greatest(F.col("host_pages"), F.lit(SMALL_HOST)))
    return pages.join(totals.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_"))).filter(enough & (F.col("pages") > F.lit(most_share) * F.col("host_pages"))).drop("host_")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_dropped, the lines taken out of each row."""
    found = durable(boilerplate(docs, text_col, host_col, most_share, least_pages))
    hosts = found.groupBy(F.col("host").alias("host_")).agg(F.collect_set("line").alias("bad_"))
    given = docs.select(F.struct("*").alias("row_"), F.col(host_col).alias("of_"), F.col(text_col).alias("text_"))
    if found.count() <= BROADCAST_LINES:
        met = given.join(F.broadcast(hosts), F.col("of_").eqNullSafe(F.col("host_")), "left")
    else:
        salted = hosts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # maps and variants have no hash; copies of one text have ids that differ
        hashed = [F.col(f"row_.`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
        salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
        met = given.withColumn("spread_", salt).join(salted, F.col("of_").eqNullSafe(F.col("host_")) & (F.col("spread_") == F.col("salt_")), "left")
    # a host's list is looked through once for a document, then only the lines found are
    lines = _lines(F.col("text_"))
    met = met.withColumn("here_", F.array_intersect("bad_", F.transform(lines, lambda x: F.xxhash64(x))))
    kept = F.filter(lines, lambda x: ~F.array_contains("here_", F.xxhash64(x)))
    none = F.coalesce(F.size("here_"), F.lit(0)) <= 0
    text = F.when(none, F.col("text_")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped")
    return met.select(*[text.alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in docs.columns if c != "n_dropped"], dropped)
