"""Retrieval: term statistics, BM25, exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD, tokens

#: Vectors in a block of exact search, and queries that meet a block in one task, about.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
#: Products of unit vectors this close to the k-th best are told apart by their rounded score: half of its last place, twice, and more than any error of a sum.
SLACK = 2e-6
#: Terms of all queries that are broadcast at most; beyond it they meet documents by a shuffled join.
BROADCAST_TERMS = 1_000_000


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, pattern: str = WORD) -> DataFrame:
    """item_id, doc_id, score, rank: the k best of docs (doc_id, text) for each of queries (item_id, text).

    Only terms that a query has are counted. Up to BROADCAST_TERMS queries' terms are
    broadcast, and a document's terms meet in one task, so its scores for all queries
    need no shuffle before the k best of a task are taken.
    """
    asked = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text"), pattern))).alias("term"))
    sent = F.broadcast if asked.count() <= BROADCAST_TERMS else lambda x: x
    terms = docs.select("doc_id", tokens(F.col("text"), pattern).alias("t")).withColumn("size", F.size("t"))
    total = terms.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))  # one row
    # outer: else a filter of empty arrays is made, for which texts are split once more; a null term meets none
    found = terms.select("doc_id", "size", F.explode_outer("t").alias("term")).join(sent(asked.select("term").distinct()), "term", "left_semi").repartition("doc_id")
    tf = found.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    weighed = tf.join(sent(df), "term").join(F.broadcast(total)).select("doc_id", "term", part.alias("part"))
    scored = weighed.join(sent(asked), "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, vec_id, score, rank: the k rows of vectors with the highest cosine (6 places, smaller ids first) for each row of queries, exactly.

    Rows and queries are packed into blocks of bounded size; where two blocks meet, one
    matrix product finds the candidates of each query (all whose product is within
    SLACK of the k-th best), whose scores are then summed in order, as a row's own
    cosine is; so little more than k of each block are shuffled. A query never finds its own id;
    vectors that are null, zero, hold null or non-finite components, or have another
    length than the query's take no part.
    """
    rows, asked = (_units(x, id_col, vector_col).withColumn("dim", F.size("u")) for x in (vectors, queries))
    n, m = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // block_queries))
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    packed = lambda df, parts, block: df.groupBy("dim", deal(parts).alias(block)).agg(F.collect_list("id").alias(f"{block}_ids"), F.flatten(F.collect_list("u")).alias(f"{block}_u"))
    blocks = packed(rows, n, "block").withColumn("part", every(m))
    sent = packed(asked, m, "part").withColumn("block", every(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b["dim"][i].as_py()
                ids, qs = (b[c][i].values.to_numpy() for c in ("block_ids", "part_ids"))
                x, q = (b[c][i].values.to_numpy().reshape(-1, dim) for c in ("block_u", "part_u"))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                near = q @ x.T
                near[qs[:, None] == ids[None, :]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qs), -np.inf)
                at, of = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                # in the order of the components, as a fold
                score = np.zeros(len(at))
                for c in range(dim):
                    score += x[of, c] * q[at, c]
                # of candidates with one score, which copies have, the k of the smallest ids (they come by id)
                by = np.lexsort((of, -score, at))
                at, of, score = at[by], of[by], score[by]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (at[1:] != at[:-1]) | (score[1:] != score[:-1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                some = np.arange(len(at)) - first < k
                at, of, score = at[some], of[some], score[some]
                yield pa.record_batch([pa.array(qs[at]), pa.array(ids[of]), pa.array(score)], ["query_id", "vec_id", "score"])

    kind = dict(rows.dtypes)["id"]
    met = blocks.join(sent.hint("merge"), ["dim", "block", "part"]).select("dim", "block_ids", "block_u", "part_ids", "part_u")
    near = met.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double").select("query_id", "vec_id", F.round("score", 6).alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, u: the vectors that have a direction, at length one."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = given.filter(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sized = finite.withColumn("size", F.sqrt(_dot(F.col("v"), F.col("v")))).filter("size > 0")
    return sized.select("id", F.transform("v", lambda x: x / F.col("size")).alias("u"))
