"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of the first d turns (role, text) of conversations; its
members are the conversations that begin with it, and its owner is the smallest of
them. A conversation that owns a node owns every longer prefix of itself, so what it
owns is a suffix of its path, and each node has exactly one owner. Hence one grouping
of all (conversation, depth) rows by prefix gives every figure of a node's subtree:
words that members say from there on less the words that they own there are what the
subtree repeats; a leaf is counted at its owner, and so is each child.

A prefix is known by running sums of hashes of (place, turn), which windows over
blocks of BLOCK turns make, so neither a long conversation nor a node that all
conversations share needs a task of its own: owners come from a grouping that sums up
before its shuffle (a window over a node's members would hold all of them at the root),
and places within a conversation from a sort by range. Texts are shuffled once; after
that rows hold digests. The ids that end at a node go into its digest in order, as a
stream.

Defined results: null roles and texts are empty; turns that share a number come by
role, then text, and null numbers first; repeated rows are turns of their own; rows
without conversation id are left out; an empty table gives an empty trie; other columns
are not read. Prefixes are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.components import told
from corpusmill.session import durable

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
LANES = 4
#: Hashes summed up are this wide, so sums of 2^24 turns stay within a long.
LANE_MASK = (1 << 39) - 1
#: Conversations i and i - i % FAMILY share up to HEAD - 1 first turns in shared_heads().
FAMILY, HEAD = 20, 4


def numbered(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, place (from 1), of (rows of the conversation), digest (of role and text), words: every turn in its order.

    Rows are sorted by range over the whole table, so the turns of one conversation may
    lie in several partitions; how many lie before is counted by (conversation, partition).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = convs.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).filter("conv_id is not null")
    ranges = given.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = durable(ranges.select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    here = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = here.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("conv_id")).alias("of"))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") - F.col("first") + 1 + F.col("before")).alias("place"), "of", "digest", "words")


def plain_paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words, len of conversations as they are, with the root of each; turns as numbered() gives them."""
    root = turns.filter("place = 1").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), F.col("of").alias("len"))
    return turns.select("conv_id", F.col("place").alias("depth"), "digest", "words", F.col("of").alias("len")).union(root)


def shared_heads(turns: DataFrame) -> DataFrame:
    """As plain_paths, but a conversation's first h turns are those of its family's first conversation, h from a checksum of its id."""
    turns = durable(turns)
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEAD)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    ids = turns.filter("place = 1").select("conv_id", "of", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("of_"))
    met = ids.join(heads.withColumnRenamed("conv_id", "head_of"), F.col("of_") == F.col("head_of"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>"))
    facts = met.select("conv_id", "h", head.alias("head"))
    facts = facts.withColumn("shift", F.size("head") - F.col("h"))
    # a conversation's facts meet each (conversation, part) once, and rows meet those
    spread = turns.select("conv_id", "part", "of").distinct().join(facts.select("conv_id", "h", "shift"), "conv_id")
    size = lambda of, h, n: n + F.greatest(of - h, F.lit(0))
    own = turns.drop("of").join(spread, ["conv_id", "part"]).filter("place > h")
    own = own.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "digest", "words", size(F.col("of"), F.col("h"), F.col("h") + F.col("shift")).alias("len"))
    sized = met.select("conv_id", head.alias("head"), size(F.col("of"), F.col("h"), F.size(head)).alias("len"))
    led = sized.select("conv_id", F.explode("head").alias("t"), "len").select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.words", "len")
    root = sized.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), "len")
    return own.union(led).union(root)


def _key(depth: Column, lanes: list[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), depth, *lanes)


def prefixes(paths: DataFrame) -> DataFrame:
    """conv_id, block, depth, len, words and upto (words to here) of every row of paths; (a, b) is its prefix, (pa, pb) the one before, null at the root."""
    rows = durable(paths.withColumn("block", F.expr(f"depth div {BLOCK}")))
    lane = [F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "depth", "digest").bitwiseAND(F.lit(LANE_MASK))) for k in range(LANES)]
    rows = rows.select("conv_id", "block", "depth", "len", "words", *[c.cast("long").alias(f"l{k}") for k, c in enumerate(lane)])
    summed = [f"l{k}" for k in range(LANES)] + ["words"]
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in summed])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in summed])
    within = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.join(totals, ["conv_id", "block"]).select("conv_id", "block", "depth", "len", "words", *[f"l{k}" for k in range(LANES)], *[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(f"{c}_to") for c in summed])
    here, above = [F.col(f"l{k}_to") for k in range(LANES)], [F.col(f"l{k}_to") - F.col(f"l{k}") for k in range(LANES)]
    parent = lambda seed: F.when(F.col("depth") > 0, _key(F.col("depth") - 1, above, seed))
    return run.select("conv_id", "block", "depth", "len", "words", F.col("words_to").alias("upto"), _key(F.col("depth"), here, 1).alias("a"), _key(F.col("depth"), here, 2).alias("b"), parent(1).alias("pa"), parent(2).alias("pb"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node in order, a batch's at a time, as text."""
    for batch in batches:
        a, b, ids = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(a)]))
        if len(a):
            yield pa.record_batch([pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array([",".join(map(str, ids[i:j])) for i, j in zip(starts, ends)])], ["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over its chunks, which come in order."""
    now, state = None, None
    done: list[tuple[int, int, str]] = []
    out = lambda: pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["a", "b", "ends"])
    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) == now:
                state.update(b",")
            else:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield out()
            done = []
    if now:
        done = [(*now, state.hexdigest())]
        yield out()


def end_digests(paths: DataFrame) -> DataFrame:
    """a, b, ends: SHA-256 of the ids, ascending and joined by commas, of the conversations that end at each node where any does."""
    ends = paths.filter("depth = len").select("a", "b", "conv_id")
    chunks = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_chunks, "a long, b long, first long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends string")


def trie(paths: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its prefix (a, b)."""
    rows = durable(prefixes(paths))
    nodes = rows.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.max("len").alias("longest"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min(F.col("upto") - F.col("words")).alias("before"))
    nodes = durable(nodes)
    owned = nodes.groupBy("owner").agg(
        F.min("depth").alias("since"), F.min("before").alias("start"), F.max("depth").alias("deepest"), F.max_by("longest", "depth").alias("longest"), F.min_by("pa", "depth").alias("pa"), F.min_by("pb", "depth").alias("pb")
    )
    branches = owned.filter("since > 0")
    above = told(branches, nodes.select("a", "b", F.col("owner").alias("above")).toDF("pa", "pb", "above"), ["pa", "pb"], "owner")
    columns = ["owner", "since", "start", (F.col("longest") == F.col("deepest")).alias("leaf"), "above"]
    owners = above.select(*columns).union(owned.filter("since = 0").withColumn("above", F.lit(None).cast("long")).select(*columns))
    convs = rows.filter("depth = len").select("conv_id", F.col("len").alias("of"), F.col("upto").alias("said")).join(owners, F.col("conv_id") == F.col("owner"), "left")
    facts = convs.select(
        F.col("conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"of div {BLOCK}"))).alias("block"), F.coalesce("since", F.col("of") + 1).alias("since"), F.coalesce("start", "said").alias("start"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "above"
    )
    depth, since = F.col("depth"), F.col("since")
    figures = rows.join(facts, ["conv_id", "block"]).groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.max(F.when(depth > since, F.col("conv_id")).when(depth == since, F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((since <= depth + 1) & (depth < F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("start") - (F.col("upto") - F.col("words")), F.lit(0))).alias("saved_tokens"),
    )
    ended = figures.join(end_digests(rows), ["a", "b"], "left")
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "a", "b")
