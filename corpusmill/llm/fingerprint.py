"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, modulo 2^64 and 2^32 in the two parts of the
vector. Sums do not depend on order, and paragraphs are put in or taken out by
adding or subtracting their vectors. The first part (EXACT lanes of 64 bits,
BLAKE2b of the paragraph) serves equality; the second (SKETCH signed lanes of 32
bits, to which each WINDOW-byte window of the paragraph adds one sign, and a
shorter paragraph that is not empty one sign of its whole bytes) keeps inner
products, so the cosine of two sketches estimates how much text two documents
share.

Defined results: null is the empty text, whose fingerprint is all zeros; texts
with the same paragraphs in another order have equal fingerprints; equal
fingerprints have likeness 1, those of unequal exact parts at most BELOW_ONE, and an
empty text has likeness 0 with any other; texts of any length are taken whole; rows
that repeat an id follow each other by text (all of one id in one slice); an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H

EXACT, SKETCH, WINDOW = 8, 128, 16
#: Likeness of texts whose exact parts differ, at most.
BELOW_ONE = 1 - 2.0**-20
#: Slices of the id range in which neighbours are found, at most; their bounds are told to all tasks.
MOST_SLICES = 20_000


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes, sketch lanes) of each text."""
    raw = [t.encode() for t in texts]
    exact = np.zeros((len(raw), EXACT), np.uint64)
    sketch = np.zeros((len(raw), SKETCH), np.uint32)
    blake = hashlib.blake2b
    for i, t in enumerate(raw):
        if t:
            lines = t.split(b"\n")
            hashed = np.frombuffer(b"".join([blake(x).digest() for x in lines]), np.uint64).reshape(len(lines), EXACT)
            exact[i] = hashed.sum(axis=0, dtype=np.uint64)
    start = 0
    while start < len(raw):
        end, size = start, 0
        while end < len(raw) and (size == 0 or size + len(raw[end]) <= H.CHUNK_BYTES // 2):
            size += len(raw[end]) + 1
            end += 1
        sketch[start:end] = _sketches(raw[start:end])
        start = end
    return exact, sketch


def _sketches(raw: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"\n".join(raw) + b"\n" * (WINDOW + 8), np.uint8)
    n = len(data) - WINDOW - 7
    words = np.empty(n + 8, np.uint64)  # the eight bytes from each place
    for k in range(8):
        part = data[k : k + (n + 8 - k + 7) // 8 * 8]
        part = np.frombuffer(part.tobytes() + b"\n" * (-len(part) % 8), np.uint64)
        words[k::8] = part[: len(words[k::8])]
    h = H.mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8 : n + 8])
    ends = np.cumsum([len(x) + 1 for x in raw])
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    within = np.flatnonzero(breaks[WINDOW : n + WINDOW] == breaks[:n])  # windows inside one paragraph
    short, signs = _short_lines(data, words, int(ends[-1]))
    at, h = np.concatenate((within, short)), np.concatenate((h[within], signs))
    row = np.searchsorted(ends, at, "right")
    lane = row * SKETCH + (h >> np.uint64(57)).astype(np.int64)
    sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64)
    return np.bincount(lane, sign, minlength=len(raw) * SKETCH).astype(np.int64).astype(np.uint32).reshape(len(raw), SKETCH)


def _short_lines(data: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the lines of 1 to WINDOW - 1 bytes among the first `size` bytes."""
    stops = np.flatnonzero(data[:size] == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    length = stops - starts
    some = (length > 0) & (length < WINDOW)
    starts, length = starts[some], length[some].astype(np.uint64)
    kept = lambda n: np.where(n < 8, (np.uint64(1) << (np.uint64(8) * np.minimum(n, np.uint64(7)))) - np.uint64(1), ~np.uint64(0))
    first = words[starts] & kept(length)
    second = words[starts + 8] & kept(np.maximum(length, np.uint64(8)) - np.uint64(8))
    return starts, H.mix(first * np.uint64(0x9E3779B97F4A7C15) + second + length * np.uint64(0xC2B2AE3D27D4EB4F))


def as_text(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [e.tobytes().hex() + s.tobytes().hex() for e, s in zip(exact, sketch)]


def from_text(value: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(value)
    return np.frombuffer(raw[: EXACT * 8], np.uint64), np.frombuffer(raw[EXACT * 8 :], np.uint32)


def combine(value: str, other: str, sign: int = 1) -> str:
    """The fingerprint after other's paragraphs are put in (sign 1) or taken out (-1)."""
    (e, s), (f, t) = from_text(value), from_text(other)
    return as_text([e + f], [s + t])[0] if sign > 0 else as_text([e - f], [s - t])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each row of two (exact, sketch) pairs."""
    x, y = (s.view(np.int32).astype(np.float64) for s in (np.ascontiguousarray(a[1]), np.ascontiguousarray(b[1])))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a[0] == b[0]).all(axis=1)
    return np.where(same & (x == y).all(axis=1), 1.0, np.clip(cosine, 0, np.where(same, 1.0, BELOW_ONE)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(as_text(*vectors([t or "" for t in b.column(1).to_pylist()])), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _slice_of(bounds: list[int], doc_id: Column) -> Column:
    """How many bounds lie below doc_id, looked up in two levels."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    below = F.size(F.filter(tops, lambda b: b < doc_id))
    inside = F.size(F.filter(F.try_element_at(table, below + 1), lambda b: b < doc_id))
    return below * F.lit(step) + F.greatest(inside, F.lit(0))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, own, slice, such that every slice holds, after its own rows, the row that follows them by descending id.

    Slices are ranges of ids whose upper ends are ids of the table (quantiles), so
    the row to carry into the next slice is the one that equals a bound.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = given.count()
    if not n:
        return given.select("doc_id", "text", F.lit(True).alias("own"), F.lit(0).alias("slice"))
    width = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(MOST_SLICES, max(8 * width, n // 2000), n // 4))
    shares = [i / count for i in range(1, count)] + [1.0]
    bounds = sorted(set(given.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * count))).first()[0]) | {given.agg(F.max("doc_id")).first()[0]})
    own = F.struct(_slice_of(bounds, F.col("doc_id")).alias("slice"), F.lit(True).alias("own"))
    held = F.struct(F.pmod(own["slice"] + 1, F.lit(len(bounds))).alias("slice"), F.lit(False).alias("own"))
    ends = given.sparkSession.createDataFrame([(b,) for b in bounds], "bound long")  # MOST_SLICES + 1 at most
    given = given.join(F.broadcast(ends), F.col("doc_id") == F.col("bound"), "left")
    rows = given.withColumn("at", F.explode(F.when(F.col("bound").isNotNull(), F.array(own, held)).otherwise(F.array(own))))
    return rows.select("doc_id", "text", "at.own", "at.slice")


def edited(text: str, following: str) -> str:
    """text whose last half is replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint, its edited text's, and its likeness to that and to the next row's.

    Rows follow each other by descending id, rows of one id by text; a null id is
    the least and comes back as null.
    """
    rows = with_next(docs, id_col, text_col)
    placed = rows.repartition("slice").sortWithinPartitions("slice", F.col("own").desc(), F.col("doc_id").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (slice, doc_id, text, exact, sketch)
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, own, at = (c.to_pylist() for c in b.columns)
            exact, sketch = vectors(texts)
            if last:
                ids, texts, own, at = [last[1], *ids], [last[2], *texts], [True, *own], [last[0], *at]
                exact, sketch = np.vstack([last[3], exact]), np.vstack([last[4], sketch])
            here = [i for i in range(len(ids) - 1) if own[i] and at[i] == at[i + 1]]
            follow = [i + 1 for i in here]
            news = [edited(texts[i], texts[i + 1]) for i in here]
            new = vectors(news)
            mine = exact[here], sketch[here]
            yield pa.record_batch(
                [
                    pa.array([ids[i] for i in here], pa.int64()),
                    pa.array([len(texts[i]) for i in here], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in news], pa.string()),
                    pa.array(as_text(*mine), pa.string()),
                    pa.array(as_text(*new), pa.string()),
                    pa.array(likeness(mine, new), pa.float64()),
                    pa.array(likeness(mine, (exact[follow], sketch[follow])), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            last = (at[-1], ids[-1], texts[-1], exact[-1], sketch[-1]) if own[-1] else None

    done = placed.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return done.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
