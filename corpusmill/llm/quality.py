"""Quality rules: plain counts of a text, and a calibrated classifier of what the rules let through.

The rules count words, their characters, symbols, repeated lines and words in repeated
windows; texts with few words or many repeated ones fail. The classifier is a logistic
regression over hashed words and word pairs and hashed runs of three and four bytes, as
shares of a text, so long and short texts weigh alike. It is trained on a bounded, seeded
sample of rows labelled for quality; a fifth of the sample is left out of that and
calibrates the logit (two numbers by logistic regression with softened labels, each
label weighed as it occurs among all labels), so scores are probabilities, and one fixed
threshold decides. Texts are counted and scored in one pass over Arrow batches.

Defined results: null and empty texts have no words and fail; labels other than 0 and 1
are left out, and of several labels of an id the largest counts; without labelled rows
of both kinds every text that the rules let through is kept, with the share of good
labels as score (1 without any); repeated rows agree; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H

# Windows of words, and what fails.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Texts with a lesser probability of being good are dropped.
KEEP_FROM = 0.5
BITS = 18
SPACE = 2 << BITS  # words and pairs, then runs of bytes
SCALE = 30.0
#: Labelled documents to learn from, of each label about so many; and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
CALIBRATED_BY = 5
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(row: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Does another item of the same row have the same hash? For those that do: 1 for the first, 2 for later ones."""
    order = np.lexsort((hashed, row))  # stable
    same = (row[order][1:] == row[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    out = np.zeros(len(row), np.int8)
    out[order[:-1][same]] = 1
    out[order[1:][same]] = 2
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a chunk."""
    rows = len(offsets) - 1
    hashed, per_row = H.words(data, offsets, fold=H.EXACT)
    windows, n = H.shingles(hashed, per_row, WINDOW)
    row = np.repeat(np.arange(rows), n)
    starts = np.repeat(np.cumsum(per_row) - per_row - (np.cumsum(n) - n), n) + np.arange(len(windows))
    again = starts[_repeats(row, windows) > 0]
    steps = np.zeros(len(hashed) + WINDOW + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + WINDOW, -1)
    inside = np.cumsum(steps)[: len(hashed)] > 0
    words = np.concatenate(([0], np.cumsum(per_row)))

    solid = ~H.WHITE[data]
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    last = np.sort(np.concatenate((breaks, offsets[1:])))
    upto = np.concatenate(([0], np.cumsum(solid)))
    with_word = upto[last] > upto[first]
    first, last = first[with_word], last[with_word]
    line_row = np.searchsorted(offsets, first, "right") - 1
    later = _repeats(line_row, H.ranges(data, first, last)) == 2
    return {
        "n_words": per_row,
        "word_chars": _by_row(solid & _STARTS_CHAR[data], offsets),
        "n_symbols": _by_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[later], minlength=rows),
        "n_repeat_words": _by_row(inside, words),
    }


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of words and word pairs, then of runs of three and four bytes, repeats included."""
    hashed, per_row = H.words(data, offsets)
    row = np.repeat(np.arange(len(per_row)), per_row)
    pair = row[1:] == row[:-1]
    both = H.mix(hashed[:-1] * np.uint64(3) + hashed[1:])[pair]
    top = np.uint64(64 - BITS)
    words = np.concatenate((row, row[1:][pair])), np.concatenate((hashed >> top, both >> top)).astype(np.int64)
    at = np.searchsorted(offsets, np.arange(len(data)), "right") - 1
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    value = data.astype(np.uint64)
    for k in (3, 4):
        if len(data) >= k:
            n = len(data) - k + 1
            code = np.full(n, k, np.uint64)
            for j in range(k):
                code = code * np.uint64(256) + value[j : j + n]
            same = at[:n] == at[k - 1 :]
            runs.append((at[:n][same], (H.mix(code[same]) >> top).astype(np.int64) + (1 << BITS)))
    none = np.zeros(0, np.int64)
    return [words, tuple(np.concatenate([r[i] for r in runs]) if runs else none for i in (0, 1))]


class Model:
    """Weights of features, bias, and the two numbers that calibrate."""

    def __init__(self, weight: np.ndarray, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weight, self.bias, self.slope, self.shift = weight.astype(np.float32), bias, slope, shift

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        out = np.full(rows, self.bias)
        for row, feature in features(data, offsets):
            total = np.bincount(row, self.weight[feature], rows)
            out += SCALE * total / np.maximum(np.bincount(row, minlength=rows), 1)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -35, 35)))


def calibrate(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through (logit, label), by Newton steps; labels are softened as if each had been met once more the other way."""
    n = np.array([max(1, (labels == y).sum()) for y in (0, 1)])
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    c = np.array([1.0, 0.0])
    loss = lambda c: (weight * (np.logaddexp(0, x @ c) - target * (x @ c))).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        gradient = x.T @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while loss(c - size * step) > loss(c) and size > 1e-6:
            size /= 2
        c = c - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return float(c[0]), float(c[1])


def _learn(docs: list[list[tuple[np.ndarray, np.ndarray]]], labels: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> Model:
    """Logistic regression, document after document, with rates that shrink by coordinate; weight corrects for how labels were drawn."""
    w, seen = np.zeros(SPACE), np.full(SPACE, 1e-3)
    bias, bias_seen = 0.0, 1e-3
    held = np.arange(len(docs)) % CALIBRATED_BY == 0 if len(docs) >= 10 * CALIBRATED_BY else np.zeros(len(docs), bool)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(np.flatnonzero(~held)):
            z = bias + sum((w[f] * v).sum() for f, v in docs[i])
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[i]
            for f, v in docs[i]:
                step = g * v
                seen[f] += step * step
                w[f] -= 0.1 * step / np.sqrt(seen[f])
            bias_seen += g * g
            bias -= 0.1 * g / np.sqrt(bias_seen)
    model = Model(w, float(bias))
    by = np.flatnonzero(held) if len(np.unique(labels[held])) == 2 else np.arange(len(docs))
    z = np.array([bias + sum((model.weight[f] * v).sum() for f, v in docs[i]) for i in by])
    model.slope, model.shift = calibrate(z, labels[by], weight[by])
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, epochs: int = 4, seed: int = 13
) -> Model:
    """Model from whole texts of about sample_rows labelled documents of each label.

    The sample is drawn from the ids of labels, seeded, so that only its texts are
    gathered; they go through one task in hash order, which takes texts until
    sample_bytes are met. An id counts once: its largest label, its least text.
    """
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id_")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    flat = np.zeros(SPACE)
    if len(sizes) < 2:
        return Model(flat, shift=-35.0 if 0 in sizes else 35.0) if sizes else Model(flat, shift=35.0)
    share = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    u = F.pmod(F.xxhash64("id_", F.lit(seed)), F.lit(1_000_000))
    drawn = given.withColumn("u", u).filter(F.col("u") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * 1_000_000)
    # the last hash decides the order, so that both labels are spread over it
    drawn = drawn.withColumn("u", F.xxhash64("id_", F.lit(seed + 1)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id_")).groupBy("id_", "label", "u").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = []
        ys: list[int] = []
        met = 0
        for b in batches:
            if met > sample_bytes:
                continue
            for first, data, offsets in H.chunks(b.column(0)):
                met += len(data)
                each: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(offsets) - 1)]
                for row, feature in features(data, offsets):
                    pair, n = np.unique(row * SPACE + feature, return_counts=True)
                    total = np.bincount(row, minlength=len(each))
                    ends = np.searchsorted(pair, np.arange(1, len(each)) * SPACE)
                    for i, (p, c) in enumerate(zip(np.split(pair, ends), np.split(n, ends))):
                        each[i].append(((p % SPACE).astype(np.int32), (SCALE * c / max(1, total[i])).astype(np.float32)))
                kept += each
                ys += b.column(1).slice(first, len(each)).to_pylist()
        y = np.array(ys, int)
        model = _learn(kept, y, np.where(y == 1, 1 / share[1], 1 / share[0]), epochs, seed)
        used = np.flatnonzero(model.weight)
        facts = [model.bias, model.slope, model.shift]
        yield pa.record_batch([pa.array(np.concatenate((used, SPACE + np.arange(3)))), pa.array(np.concatenate((model.weight[used].astype(float), facts)))], ["feature", "weight"])

    table = some.repartition(1).sortWithinPartitions("u", "id_").select("text", "label").mapInArrow(run, "feature long, weight double").toPandas()
    at, value = table["feature"].to_numpy(), table["weight"].to_numpy()
    if not len(at):  # no labelled text
        return Model(flat, shift=float(np.log(sizes[1] / sizes[0])))
    flat[at[at < SPACE]] = value[at < SPACE]
    bias, slope, shift = value[at >= SPACE]
    return Model(flat, bias, slope, shift)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the five counts, score (probability of a good text), base_failed, kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = {c: np.zeros(b.num_rows, np.int64) for c in COUNTS}
            logits = np.zeros(b.num_rows)
            for first, data, offsets in H.chunks(b.column(1)):
                here = slice(first, first + len(offsets) - 1)
                for c, v in counts(data, offsets).items():
                    found[c][here] = v
                logits[here] = m.logits(data, offsets)
            score = m.probabilities(logits)
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
            yield pa.record_batch([b.column(0), *[pa.array(found[c]) for c in COUNTS], pa.array(score), pa.array(failed), pa.array(~failed & (score >= keep_from))], ["doc_id", *COUNTS, "score", "base_failed", "kept"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id long, {', '.join(c + ' long' for c in COUNTS)}, score double, base_failed boolean, kept boolean")
