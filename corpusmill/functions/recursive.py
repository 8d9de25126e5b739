"""Recursive chunks: a text is cut at the first kind of separator that parts it, its parts at the next, until they fit; small neighbours are joined again.

Chunks are ranges that cover the whole text, none of them longer than the limit. Where
no separator parts a text that is too long, or too many levels are open, it is cut by
length. A text is one loop with a stack of its own; texts go through it in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters, levels, and separators in the order in which they are tried.
MOST, TARGET, LEVELS, OVERLAP = 1024, 512, 7, 50
SEPARATORS = (r"\n\s*(?:KISIM|BÖLÜM)\s*", r"\n\s*(?:MADDE|Madde)\s+\d+", r"\n\n", r"\.\s+", r"\s+")


def _cuts(text: str, start: int, stop: int, separators: list[re.Pattern]) -> list[int]:
    """Where the first separator that parts text[start:stop] begins: a separator goes with what follows it, as does a blank beginning."""
    solid = re.compile(r"\S").search(text, start, stop)
    for s in separators if solid else ():
        found = [m.start() for m in s.finditer(text, start, stop) if m.start() > solid.start()]
        if found:
            return found
    return []


def _joined(spans: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for start, stop, depth in spans:
        if out and stop - out[-1][0] <= most:
            out[-1] = (out[-1][0], stop, out[-1][2])
        else:
            out.append((start, stop, depth))
    return out


def ranges(text: str, most: int = MOST, target: int = TARGET, levels: int = LEVELS, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int, int]]:
    """(start, stop, depth) of the chunks of a text, in order."""
    if not text.strip():
        return []
    compiled = [re.compile(s, re.MULTILINE | re.IGNORECASE) for s in separators]
    # a frame holds the parts of one level that are still to do, last first, and its chunks so far
    stack: list[tuple[list[tuple[int, int]], list[tuple[int, int, int]], int]] = [([(0, len(text))], [], 0)]
    while True:
        todo, done, depth = stack[-1]
        if not todo:
            stack.pop()
            if not stack:
                return done
            stack[-1][1].extend(_joined(done, most))
            continue
        start, stop = todo.pop()
        cuts = _cuts(text, start, stop, compiled) if stop - start > most and depth < levels else []
        if cuts:
            edges = [start, *cuts, stop]
            stack.append((list(zip(edges, edges[1:]))[::-1], [], depth + 1))
        elif stop - start > most:
            done += [(at, min(at + target, stop), depth) for at in range(start, stop, target)]
        else:
            done.append((start, stop, depth))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, target: int = TARGET, levels: int = LEVELS, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """doc_id, chunk (from 0), start, stop, depth, part (the text of the range), after (the beginning of the next one); null and blank texts have none."""
    if target > most:
        raise ValueError("target is over most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                found = ranges(text, most, target, levels, separators)
                if found:
                    starts, stops, depths = zip(*found)
                    after = [text[s : min(s + overlap, e)] for s, e, _ in found[1:]] + [""]
                    yield pa.record_batch(
                        [pa.array([i.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(depths, pa.int32()), pa.array([text[s:e] for s, e, _ in found]), pa.array(after)],
                        ["doc_id", "chunk", "start", "stop", "depth", "part", "after"],
                    )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return given.mapInArrow(run, "doc_id long, chunk int, start int, stop int, depth int, part string, after string")
