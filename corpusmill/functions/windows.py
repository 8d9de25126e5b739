"""Sliding windows over whole texts that end at sentences and come closer where marks of importance occur.

Where the next window begins depends on what this one holds, so a text is a loop;
texts go through it in Arrow batches, each alone, so nothing is gathered.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Window, stride and least overlap in characters; how far a sentence end is looked for.
SIZE, STRIDE, LEAST, REACH = 512, 256, 50, 200
SENTENCE_END = r"[.!?]\s+"
ARTICLE, AMENDMENT, CITATION = r"(?:MADDE|Madde)\s+\d+", r"değiştirilmiştir|yürürlükten kaldırılmıştır|eklenmiştir", r"\d+\s+sayılı"
#: A text with a match has one of these.
MARKS, CITED = ("MADDE", "Madde", *AMENDMENT.split("|")), "sayılı"


def bounds(text: str, size: int = SIZE, stride: int = STRIDE) -> list[tuple[int, int]]:
    """(start, end) of each window: it ends at the first sentence end within REACH characters after `size`, else at the last one within REACH before, else there.

    The next one begins half a stride on after an article or amendment mark, three
    quarters after a citation, a whole stride else. Windows of white space are left out.
    """
    closes = [m.span() for m in re.finditer(SENTENCE_END, text)]
    starts, ends = [c[0] for c in closes], [c[1] for c in closes]
    close, half, some = re.compile(f"{ARTICLE}|{AMENDMENT}"), max(stride // 2, LEAST), max(int(stride * 0.75), LEAST)
    cited, out, at = re.compile(CITATION), [], 0
    # most texts have none of the words, and windows overlap: only texts with one are searched window by window
    closing, citing = any(w in text for w in MARKS), CITED in text
    while at < len(text):
        end = at + size
        if end < len(text):
            # a match that begins before the place and ends after it counts from the place on, where white space still follows a mark
            i = bisect_left(starts, end)
            if i < len(closes) and ends[i] <= end + REACH:
                end = ends[i]
            else:
                j = bisect_right(ends, end) - 1
                end = ends[j] if j >= 0 and starts[j] >= end - REACH else end
        end = min(end, len(text))
        if not text[at:end].strip():
            at = max(end, at + 1)
            continue
        out.append((at, end))
        at += half if closing and close.search(text, at, end) else some if citing and cited.search(text, at, end) else stride
    return out


def sliding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """doc_id, chunk, start, stop, overlap (with the window before), window; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = bounds(t or "", size, stride)
                if spans:
                    laps = [0] + [max(0, a[1] - c[0]) for a, c in zip(spans, spans[1:])]
                    yield pa.record_batch(
                        [pa.array([i] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32()), pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32()), pa.array(laps, pa.int32()), pa.array([t[s:e] for s, e in spans], pa.string())],
                        ["doc_id", "chunk", "start", "stop", "overlap", "window"],
                    )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return given.mapInArrow(run, "doc_id long, chunk int, start int, stop int, overlap int, window string")
