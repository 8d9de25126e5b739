"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: the
trigrams that every match must contain, as AND and OR of three-byte strings in
lower case. Texts are indexed by segment (the texts of a chunk of a task's input):
a posting for each trigram that any rule asks for, as a set of rows. A rule's
query is answered by intersecting and uniting postings, and only the rows that
remain are searched with the expression itself. Rules without mandatory trigrams
search all rows. Segments are never shuffled and nothing outlives its task.

Defined results: null and empty texts have no spans; spans count code points, end
exclusive; matches of a rule do not overlap, leftmost first, and those that are
too short are dropped; texts of any length are searched whole; repeated rows
agree; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H

_parse = re._parser.parse  # the standard library's own parser of expressions


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
#: Spans beyond the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# A trigram query: True (anything), ("tri", t), ("and", parts), ("or", parts).
_SETS = 12  # texts of an expression's part are listed up to this many


def _and(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_texts(texts: set[str]) -> object:
    """Query for: one of these texts occurs."""
    raw = [t.lower().encode() for t in sorted(texts)]
    return _or([_and([("tri", t[i : i + 3]) for i in range(len(t) - 2)]) for t in raw])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all texts that the part matches, if few, else None; query that holds beside)."""
    known: set[str] | None = {""}
    queries: list = []

    def flush():
        nonlocal known
        if known is not None and known != {""}:
            queries.append(_of_texts(known))
        known = {""}

    whole = True
    for op, arg in tree:
        name = str(op)
        texts, query = None, True
        if name == "LITERAL":
            texts = {chr(arg)}
        elif name == "SUBPATTERN":
            texts, query = _walk(arg[3])
        elif name == "BRANCH":
            each = [_walk(p) for p in arg[1]]
            if all(t is not None for t, _ in each) and sum(len(t) for t, _ in each) <= _SETS:
                texts = set().union(*[t for t, _ in each])
            else:
                query = _or([_and([q, _of_texts(t) if t is not None else True]) for t, q in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, part = arg
            inner, q = _walk(part)
            if hi == 1 and inner is not None:
                texts = inner | {""}
            elif lo >= 1:
                query = _and([q, _of_texts(inner) if inner is not None else True])
        elif name == "AT":
            texts = {""}
        elif name == "IN" and len(arg) <= _SETS and all(str(o) == "LITERAL" for o, _ in arg):
            texts = {chr(c) for _, c in arg}
        if query is not True:
            queries.append(query)
        if texts is not None and known is not None and len(known) * len(texts) <= _SETS:
            known = {a + b for a in known for b in texts}
            continue
        flush()
        if texts is not None:
            known = texts
            whole = False
        else:
            whole = False
    if whole:
        return known, _and(queries)
    flush()
    return None, _and(queries)


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of an expression; True when it has no mandatory trigram."""
    texts, query = _walk(_parse(pattern))
    return _and([query, _of_texts(texts) if texts is not None else True])


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(p) for p in query[1]])


class Segment:
    """Postings of one chunk of texts for the trigrams asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, wanted: list[bytes]):
        self.rows = len(offsets) - 1
        self.postings = {t: np.zeros(self.rows, bool) for t in wanted}
        if len(data) > 2:
            low = H.LOWER[data].astype(np.uint32)
            code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
            number = table[code]
            at = np.flatnonzero(number)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[row + 1]
            for k in range(len(wanted)):
                self.postings[wanted[k]][row[inside & (number[at] == k + 1)]] = True

    def answer(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.rows, bool)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = [self.answer(p) for p in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    """Rules with their queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [r.compiled() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = sorted(set().union(*[trigrams(q) for q in self.queries]))
        self.table = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 255 else np.uint16)
        for k, t in enumerate(self.wanted):
            self.table[int.from_bytes(t, "big")] = k + 1
        # a too short match of one greedy class is skipped at once, with the same matches left
        self.fast = [
            re.compile(r.pattern[:-1] + f"{{{r.least},}}", re.ASCII) if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.ignore_case else None for r in rules
        ]

    def spans(self, k: int, text: str) -> list[tuple[int, int]]:
        if self.fast[k]:
            return [m.span() for m in self.fast[k].finditer(text)]
        rule = self.rules[k]
        return [m.span() for m in self.patterns[k].finditer(text) if len(m.group(rule.group)) >= rule.least]

    def scan(self, column: pa.Array) -> Iterator[list[list[tuple[int, int]]]]:
        """For each row, the spans of each rule."""
        for first, data, offsets in H.chunks(column):
            segment = Segment(data, offsets, self.table, self.wanted)
            hits = [segment.answer(q) for q in self.queries]
            for row in range(len(offsets) - 1):
                text = None
                found: list[list[tuple[int, int]]] = []
                for k in range(len(self.rules)):
                    if not hits[k][row]:
                        found.append([])
                        continue
                    if text is None:
                        text = column[first + row].as_py() or ""
                    found.append(self.spans(k, text))
                yield found


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end of every span, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in batches:
            out = [(i, r.kind, *span) for i, found in zip(b.column(0).to_pylist(), s.scan(b.column(1))) for r, spans in zip(rules, found) for span in spans]
            yield pa.record_batch(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32())],
                ["doc_id", "kind", "start", "end"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, kind string, start int, end int")


def scan_digests(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs."""
    rules = BASE_RULES + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            counts, digests, spans = [], [], []
            for found in s.scan(b.column(1)):
                listed = sorted((start, k, end) for k, x in enumerate(found) for start, end in x)
                text = [f"{rules[k].kind}:{start}:{end}" for start, k, end in listed]
                base = ",".join([t for t, (_, k, _) in zip(text, listed) if k < len(BASE_RULES)])
                counts.append([len(x) for x in found[:3]])
                digests.append(hashlib.sha256(base.encode()).hexdigest() if base else none)
                spans.append(",".join(text))
            yield pa.record_batch(
                [b.column(0), *[pa.array([c[j] for c in counts], pa.int64()) for j in range(3)], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
