"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted by spherical k-means on a bounded, seeded sample of unit
vectors; every row of the table is then put in the leaf that its descent reaches.
A query goes down the tree with a priority queue of branches, nearest centre
first, and takes leaves in the order in which they come off the queue. How many
leaves it visits is calibrated: the number is widened until sample queries find
TARGET of their true neighbours in the sample; beyond that number a query goes on
until its leaves hold k rows besides its own id.

Queries and rows meet by leaf. Leaves are cut in parts of about PART_ROWS rows, so
that a leaf with very many rows (copies of one vector, say) is spread over tasks;
each part keeps the k best of each query, and the best of those are the result.

Scores are the cosines of the original vectors in double precision, one fixed
order of summation for each pair, so equal vectors tie exactly and smaller ids win.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor do those of another length than most, whose cosine with the others
is not defined; nor do rows without an id, as queries or candidates; vectors of any
scale count by their direction; rows that repeat an id are
candidates of their own, except that a query never finds its own id; a table with
fewer than k candidates gives all of them; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import durable

FIT_ROWS = 20_000
CALIBRATION_QUERIES = 300
TARGET = 0.97
BRANCHES = 8
LEAF_ROWS = 100
PART_ROWS = 4096


class Tree:
    """Centres of a hierarchical k-means tree over unit vectors."""

    def __init__(self, x: np.ndarray, seed: int = 3, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS):
        self.children: list[np.ndarray] = []  # of each node; empty for a leaf
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self._grow(x, branches, leaf_rows)

    def _grow(self, x: np.ndarray, branches: int, leaf_rows: int) -> int:
        me = len(self.children)
        self.children.append(np.zeros(0, int))
        self.centres.append(np.zeros((0, x.shape[1] if x.ndim == 2 else 0)))
        self.leaf.append(-1)
        if len(x) > leaf_rows:
            centre = self._kmeans(x, branches)
            near = (x @ centre.T).argmax(axis=1)
            sizes = np.bincount(near, minlength=len(centre))
            if sizes.max() < len(x):
                used = np.flatnonzero(sizes)
                self.centres[me] = centre[used]
                self.children[me] = np.array([self._grow(x[near == k], branches, leaf_rows) for k in used])
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def _kmeans(self, x: np.ndarray, k: int) -> np.ndarray:
        distinct = np.unique(x[self.rng.permutation(len(x))[: 50 * k]], axis=0)
        centre = distinct[self.rng.permutation(len(distinct))[:k]]
        for _ in range(8):
            near = (x @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
        return centre

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row's descent reaches."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = _dots(x[rows], self.centres[node]).argmax(axis=1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in the order in which best-bin-first search comes to them: `visits`, and more until they hold `least` rows by `sizes`."""
        found: list[int] = []
        held = 0
        queue = [(0.0, 0)]
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                far = 1 - self.centres[node] @ q
                order = np.argsort(far, kind="stable")
                for k in order[1:]:
                    heapq.heappush(queue, (far[k], int(self.children[node][k])))
                node = int(self.children[node][order[0]])
            found.append(self.leaf[node])
            held += 0 if sizes is None else int(sizes[found[-1]])
        return found


def _dots(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Products that depend on the two vectors alone, not on their place in a block."""
    return np.stack([(x * c).sum(axis=1) for c in centre], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def calibrate(tree: Tree, x: np.ndarray, queries: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of leaf visits that finds `target` of the k nearest rows of x for its rows `queries`."""
    leaf = tree.assign(x)
    need: list[int] = []
    for i in queries:
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        rank = np.zeros(tree.leaves, int)
        rank[tree.visit(x[i], tree.leaves)] = np.arange(1, tree.leaves + 1)
        need += rank[leaf[best]].tolist()
    return int(np.quantile(need, target, method="higher")) if need else tree.leaves


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & some)


def fit(vectors: DataFrame, k: int, seed: int = 5, fit_rows: int = FIT_ROWS, target: float = TARGET) -> tuple[Tree, int]:
    """(tree, leaf visits) from a seeded sample of at most about fit_rows rows of clean vectors (vec_id, v)."""
    n = vectors.count()
    u = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    rows = vectors.filter(u < int(min(1.0, fit_rows / max(1, n)) * (1 << 30))).orderBy(u, "vec_id").select("v").toPandas()["v"]
    if not len(rows):
        rows = vectors.limit(1).toPandas()["v"]
    x = _unit(_scaled(np.stack(rows.to_numpy()))) if len(rows) else np.zeros((0, 1))
    tree = Tree(x)
    queries = np.random.default_rng(seed).permutation(len(x))[:CALIBRATION_QUERIES]
    return tree, calibrate(tree, x, queries, k, target) if len(x) > 1 else max(1, tree.leaves)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS, **how) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of vectors found for every row of queries."""
    spark = vectors.sparkSession
    rows, asked = _clean(vectors, id_col, vector_col), _clean(queries, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], out)
    rows, asked = rows.filter(F.size("v") == length["n"]), asked.filter(F.size("v") == length["n"])
    tree, visits = fit(rows, k, **how)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(_unit(_matrix(b.column(1))))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "v", "leaf"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(2).to_numpy()
                leaves = [shared.value.visit(q, visits, sizes, k + int(n)) for q, n in zip(_unit(_matrix(b.column(1))), own)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "q", "leaves"])

    placed = durable(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long"))
    # leaves are bounded by the fitting sample, so their sizes may go to every task
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    # rows of a query's own id, which it never finds
    own = placed.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(0)).alias("own"))
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(parts), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    routed = asked.mapInArrow(route, "query_id long, q array<double>, leaves array<long>").select("query_id", "q", F.explode("leaves").alias("leaf"))
    sent = routed.join(F.broadcast(parts), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("query_id").alias("vec_id"), F.col("q").alias("v"))
    both = cut.withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (leaf, part, kind): the rows of a part, then its queries."""
        here, ids, mat = None, [], []
        block: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            place_ = b.column(0).to_numpy() * (1 << 31) + b.column(1).to_numpy()
            kind, vec, x = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4))
            cuts = np.flatnonzero((place_[1:] != place_[:-1]) | (kind[1:] != kind[:-1])) + 1
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, len(kind)]):
                if place_[lo] != here:
                    here, ids, mat, block = place_[lo], [], [], None
                if kind[lo] == 0:
                    ids.append(vec[lo:hi])
                    mat.append(x[lo:hi])
                    continue
                if not ids:
                    continue
                if block is None:
                    m = np.concatenate(mat)
                    block = np.concatenate(ids), m, np.sqrt((m * m).sum(axis=1))
                found.append(_top(vec[lo:hi], x[lo:hi], *block, k))
            q, v, s = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, float if j == 2 else np.int64) for j in range(3))
            yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    near = (
        both.select("leaf", "part", "kind", "vec_id", "v")
        .repartition("leaf", "part")
        .sortWithinPartitions("leaf", "part", "kind")
        .mapInArrow(best, "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither vanish nor overflow; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def _matrix(column: pa.Array) -> np.ndarray:
    return _scaled(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def _top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query, exact scores."""
    rough = (q @ x.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * size)
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        r = rough[i]
        if len(r) > k:
            edge = -np.partition(-r, k - 1)[k - 1]
            some = np.flatnonzero((r >= edge - 1e-9) & (r > -np.inf))
        else:
            some = np.flatnonzero(r > -np.inf)
        score = (x[some] * q[i]).sum(axis=1) / (size[some] * np.sqrt((q[i] * q[i]).sum()))
        first = np.lexsort((ids[some], -score))[:k]
        out.append((np.full(len(first), query_ids[i]), ids[some][first], score[first]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))  # type: ignore[return-value]
