"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes holds how often
each byte followed. A byte costs -log2 of its share in the longest known context,
or an escape (method C: distinct followers over all followers and distinct ones)
to the next shorter one, and eight bits when no context knows it. The counts are
frozen, so a text's code length under a language is a sum over its (ORDER+1)-byte
windows; the shortest code wins. The trees are compiled to tables of windows, so
that scoring is a few array lookups for all bytes of a batch at once.

Defined results: null, empty and letterless texts are `und` with score 0; ties go
to the language that sorts first; without any training text every text is `und`;
repeated rows agree; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H
from corpusmill.operators import stats
from corpusmill.session import durable

ORDER = 3
UNDETERMINED = "und"
#: Training documents are a seeded sample of about so many for each language.
SAMPLE_DOCS = 500
#: Texts of so many bytes are held to the bits a byte that all labelled ones but a share of 1 - USUAL need, times MARGIN.
LEAST_BYTES, USUAL, MARGIN = 200, 0.99, 1.6
PAD = b"\n" * ORDER
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(four-byte windows, windows of each row); a row begins after three line ends."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + ORDER * rows, 10, np.uint8)
    at = np.arange(len(data)) + ORDER * (1 + np.repeat(np.arange(rows), np.diff(offsets)))
    padded[at] = data
    p = padded.astype(np.uint32)
    if len(p) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
    w = (p[:-3] << np.uint32(24)) | (p[1:-2] << np.uint32(16)) | (p[2:-1] << np.uint32(8)) | p[3:]
    return w[at - ORDER], np.diff(offsets)


def window_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, window, c: how often each (ORDER+1)-byte window occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            found: dict[str, list[np.ndarray]] = {}
            for first, data, offsets in H.chunks(b.column(1)):
                w, per_row = _windows(data, offsets)
                of = np.repeat(langs[first : first + len(per_row)], per_row)
                for lang in set(langs[first : first + len(per_row)]):
                    found.setdefault(lang, []).append(w[of == lang])
            for lang, parts in found.items():
                w, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(w), pa.string()), pa.array(w.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "window", "c"])

    counted = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, window long, c long")
    return counted.groupBy("lang", "window").agg(F.sum("c").alias("c"))


class Trees:
    """Context trees of all languages, compiled."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n = len(self.langs)
        # levels[k]: (windows of k context bytes and a byte, cost in each language)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            own = []
            for lang in self.langs:
                w, c = counts[lang]
                keys, at = np.unique(w & mask, return_inverse=True)
                own.append((keys, np.bincount(at, c)))
            known = np.unique(np.concatenate([x[0] for x in own])) if own else np.zeros(0, np.uint32)
            contexts = np.unique(known >> np.uint32(8))
            escape = np.zeros((len(contexts), n), np.float32)
            cost = np.zeros((len(known), n), np.float32)
            lower = self.cost(known, k - 1) if n else cost
            for i, (keys, c) in enumerate(own):
                ctx, at, distinct = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, c)
                place = np.searchsorted(contexts, ctx)
                escape[place, i] = -np.log2(distinct / (total + distinct))
                cost[:, i] = lower[:, i] + escape[np.searchsorted(contexts, known >> np.uint32(8)), i]
                cost[np.searchsorted(known, keys), i] = -np.log2(c / (total + distinct)[at])
            self.levels.append((known, cost))
            self.escapes.append((contexts, escape))
        self._index()

    def _index(self) -> None:
        """Two small tables in place of a search, where the windows' halves are few."""
        known = self.levels[ORDER][0]
        halves = [np.unique(known >> np.uint32(16)), np.unique(known & np.uint32(0xFFFF))]
        self.grid = None
        if (len(halves[0]) + 1) * (len(halves[1]) + 1) <= 1 << 23:
            self.left, self.right = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
            self.left[halves[0]] = np.arange(1, len(halves[0]) + 1) * (len(halves[1]) + 1)
            self.right[halves[1]] = np.arange(1, len(halves[1]) + 1)
            self.grid = np.full((len(halves[0]) + 1) * (len(halves[1]) + 1), -1, np.int32)
            self.grid[self.left[known >> np.uint32(16)] + self.right[known & np.uint32(0xFFFF)]] = np.arange(len(known))

    def _rows(self, w: np.ndarray, k: int) -> np.ndarray:
        """Row of each window at level k, -1 where it is unknown."""
        if k == ORDER and getattr(self, "grid", None) is not None:
            return self.grid[self.left[w >> np.uint32(16)] + self.right[w & np.uint32(0xFFFF)]]
        return _find(self.levels[k][0], w)

    def cost(self, w: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of each window's last byte after its k context bytes, in each language."""
        if k < 0:
            return np.full((len(w), len(self.langs)), 8, np.float32)
        w = w & np.uint32((1 << 8 * (k + 1)) - 1)
        row = self._rows(w, k)
        missing = np.flatnonzero(row < 0)
        if not len(self.levels[k][0]):
            return self.cost(w, k - 1)
        out = self.levels[k][1][row]
        if len(missing):
            rest = w[missing]
            at = _find(self.escapes[k][0], rest >> np.uint32(8))
            more = np.where(at[:, None] < 0, np.float32(0), self.escapes[k][1][at] if len(self.escapes[k][0]) else np.float32(0))
            out[missing] = self.cost(rest, k - 1) + more
        return out

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each row's whole text in each language."""
        out = np.zeros((len(column), len(self.langs)))
        for first, data, offsets in H.chunks(column, H.CHUNK_BYTES // 4):
            w, per_row = _windows(data, offsets)
            full = np.flatnonzero(per_row)
            if len(full):
                out[first + full] = np.add.reduceat(self.cost(w), offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text and id of all documents with both."""
    return docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, seed: int) -> DataFrame:
    """lang, text of about sample_docs documents for each language."""
    labelled = _labelled(docs, id_col, text_col, lang_col).withColumn("u", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)))
    sizes = labelled.groupBy("lang").count()
    return labelled.join(F.broadcast(sizes), "lang").filter(F.col("u") * F.col("count") < sample_docs * 1_000_000)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int | None = SAMPLE_DOCS, seed: int = 7) -> Trees:
    """Trees from whole texts of a seeded sample of about sample_docs documents for each non-null language, or of all where that is None.

    What reaches the driver is the distinct windows, counted by Spark.
    """
    known = _labelled(docs, id_col, text_col, lang_col) if sample_docs is None else _sample(docs, id_col, text_col, lang_col, sample_docs, seed)
    table = window_counts(known).toPandas()
    return Trees({lang: (g["window"].to_numpy().astype(np.uint32), g["c"].to_numpy().astype(np.float64)) for lang, g in table.groupby("lang")})


def has_letter(column: pa.Array) -> np.ndarray:
    """Does each row have a letter of any script?"""
    out = np.zeros(len(column), bool)
    for first, data, offsets in H.chunks(column):
        hits = np.concatenate(([0], np.cumsum(_LETTER[data])))
        out[first : first + len(offsets) - 1] = hits[offsets[1:]] > hits[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return out


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the language under equal priors), bits (code length of a byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            text = b.column(1)
            known = has_letter(text)
            if t.langs:
                bits = t.code_lengths(text)
                best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
                least = bits.min(axis=1) if len(bits) else np.zeros(0)
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                size = np.maximum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), 1)
                langs = np.where(known, np.array(t.langs, object)[best], UNDETERMINED)
                score, per_byte = np.where(known, score, 0.0), least / size
            else:
                langs, score, per_byte = np.full(len(text), UNDETERMINED, object), np.zeros(len(text)), np.full(len(text), 8.0)
            yield pa.record_batch([b.column(0), pa.array(langs.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, bits double"
    )


def usual_bits(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The bits for each byte that a share USUAL of all labelled documents of LEAST_BYTES and more need at most in their best language (by rank), times MARGIN; 8 without any.

    A share, not the most: a few documents of noise that have a label don't switch the limit off.
    """
    long = _labelled(docs, id_col, text_col, lang_col).filter(F.octet_length("text") >= LEAST_BYTES)
    found = identify(long.select(F.lit(0).alias("doc_id"), "text"), trees).filter(F.col("lang_pred") != UNDETERMINED)
    bits = durable(found.select(F.lit(0).alias("all"), "bits"))  # a number for each text, ranked twice
    most = stats.nearest_rank(bits, "all", "bits", {"usual": USUAL}).first()
    return 8.0 if most is None else min(8.0, most["usual"] * MARGIN)


def keep_identified(docs: DataFrame, trees: Trees, text_col: str = "text", most_bits: float = 8.0, lang_col: str | None = None) -> DataFrame:
    """The rows of docs whose language is determined; lang_col, where it is null, gets the language found.

    Texts without a letter go, and texts that no tree codes in most_bits for each byte:
    a text of fewer bytes than LEAST_BYTES, whose first bytes weigh much, only goes
    beyond 8 bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("string")
    def found(text: pa.Array) -> pa.Array:
        t = shared.value
        keep = has_letter(text)
        langs = np.full(len(text), UNDETERMINED, object)
        if t.langs and len(text):
            size = np.maximum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), 1)
            bits = t.code_lengths(text)
            keep &= bits.min(axis=1) <= np.where(size < LEAST_BYTES, 8.0, most_bits) * size
            langs = np.array(t.langs, object)[bits.argmin(axis=1)]
        return pa.array(np.where(keep, langs, None).tolist(), pa.string())

    # not to be run once for the filter and once more for its result
    once = found.asNondeterministic()
    known = docs.select(F.struct("*").alias("row_"), once(F.col(text_col)).alias("found_")).filter("found_ is not null")
    pick = lambda c: F.coalesce(f"row_.`{c}`", F.when(F.col("found_") != UNDETERMINED, F.col("found_"))) if c == lang_col else F.col(f"row_.`{c}`")
    return known.select(*[pick(c).alias(c) for c in docs.columns])
