"""Differences of two texts: similarity, edits, and patches of lines, as Column functions over Arrow batches.

Similarities and edits are those of the standard library's SequenceMatcher (longest
matching block, then what lies on either side of it), which holds elements that are
more than a hundredth of a long sequence for no anchors; matching.py finds its blocks
without going through pairs of characters. Each pair of texts is a row of its own; null
texts give null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.matching import matching_blocks, opcodes
from corpusmill.functions.matching import ratio as share

EDIT = "array<struct<op:string,old:string,new:string>>"
CHANGES = f"struct<ratio:double,edits:{EDIT}>"
HUNKS = "array<struct<op:string,old_start:int,old:array<string>,new_start:int,new:array<string>>>"
APPLIED = "struct<text:string,conflicts:array<string>>"
_LINES = pa.list_(pa.string())
_EDIT = pa.list_(pa.struct([("op", pa.string()), ("old", pa.string()), ("new", pa.string())]))
_CHANGES = pa.struct([("ratio", pa.float64()), ("edits", _EDIT)])
_HUNKS = pa.list_(pa.struct([("op", pa.string()), ("old_start", pa.int32()), ("old", _LINES), ("new_start", pa.int32()), ("new", _LINES)]))
_APPLIED = pa.struct([("text", pa.string()), ("conflicts", _LINES)])


def _rows(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f over rows, one at a time; rows with a null give null."""
    out = []
    for row in zip(*columns):
        values = [v.as_py() for v in row]
        out.append(None if any(v is None for v in values) else f(*values))
    return pa.array(out, kind)


def similarity(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters of both; 1 for two empty texts."""

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return _rows(lambda s, t: share(matching_blocks(s, t)), pa.float64(), x, y)

    return ratio(a, b)


def changes(a: Column, b: Column) -> Column:
    """(ratio, edits): similarity, and what turns a into b, an (op, old, new) for every replaced, deleted or inserted piece, in order."""

    def each(s: str, t: str) -> dict:
        blocks = matching_blocks(s, t)
        return {"ratio": share(blocks), "edits": [{"op": op, "old": s[i:j], "new": t[k:l]} for op, i, j, k, l in opcodes(blocks)]}

    @F.arrow_udf(CHANGES)
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return _rows(each, _CHANGES, x, y)

    return of(a, b)


def edits(a: Column, b: Column) -> Column:
    """What turns a into b, as in changes."""
    return changes(a, b)["edits"]


_OP = {"insert": "ADD", "delete": "DELETE", "replace": "REPLACE"}


def hunks(a: Column, b: Column) -> Column:
    """A patch from a to b: hunks of lines (op ADD, DELETE or REPLACE; starts count from 0), in order."""

    def each(s: str, t: str) -> list[dict]:
        old, new = s.split("\n"), t.split("\n")
        return [{"op": _OP[op], "old_start": i, "old": old[i:j], "new_start": k, "new": new[k:l]} for op, i, j, k, l in opcodes(matching_blocks(old, new))]

    @F.arrow_udf(HUNKS)
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return _rows(each, _HUNKS, x, y)

    return of(a, b)


def reverse(patch: Column) -> Column:
    """The patch that undoes one."""
    op = lambda h: F.when(h["op"] == "ADD", "DELETE").when(h["op"] == "DELETE", "ADD").otherwise(h["op"])
    return F.transform(patch, lambda h: F.struct(op(h).alias("op"), h["new_start"].alias("old_start"), h["new"].alias("old"), h["old_start"].alias("new_start"), h["old"].alias("new")))


def patched(x: Column, patch: Column) -> Column:
    """(text, conflicts): hunks applied in order; their places are those of the text given, which is copied once from left to right.

    A hunk whose old lines are not what stands at its place is left out and named among
    the conflicts; so an empty list says that the patch fits.
    """

    def each(text: str, given: list[dict]) -> dict:
        lines, out, at, conflicts = text.split("\n"), [], 0, []
        for i, h in enumerate(given):
            start, old = h["old_start"], h["old"]
            if start < at or start + len(old) > len(lines):
                conflicts.append(f"hunk {i}: no lines {start} to {start + len(old)}")
            elif lines[start : start + len(old)] != old:
                conflicts.append(f"hunk {i}: other lines at {start}")
            else:
                out += lines[at:start] + h["new"]
                at = start + len(old)
        return {"text": "\n".join(out + lines[at:]), "conflicts": conflicts}

    @F.arrow_udf(APPLIED)
    def of(t: pa.Array, h: pa.Array) -> pa.Array:
        return _rows(each, _APPLIED, t, h)

    return of(x, patch)


def unified(patch: Column) -> Column:
    """The patch as text: a head and the lines of each hunk, - before old and + before new ones."""
    head = lambda h: F.concat(F.lit("@@ -"), (h["old_start"] + 1).cast("string"), F.lit(","), F.size(h["old"]).cast("string"), F.lit(" +"), (h["new_start"] + 1).cast("string"), F.lit(","), F.size(h["new"]).cast("string"), F.lit(" @@"))
    marked = lambda lines, sign: F.transform(lines, lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.flatten(F.transform(patch, lambda h: F.concat(F.array(head(h)), marked(h["old"], "-"), marked(h["new"], "+")))), "\n")
