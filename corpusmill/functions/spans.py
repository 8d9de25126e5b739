"""Spans of patterns in texts, as arrays of structs (start, end, kind, confidence, found), and what is done with them.

Expressions find matches and what lies between them; one pass over those, in Arrow
batches, gives offsets, so time is linear in a text and its matches (a fold of Column
functions would copy its list for every match).
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of kinds; fixed values.
PLACEHOLDERS = {"tc_id": "[TC-KIMLIK-NO]", "phone": "[TELEFON]", "email": "[E-POSTA]", "card": "[KART-NO]", "iban": "[IBAN]", "ip": "[IP-ADRESI]", "birth": "[TARIH]"}


@dataclass(frozen=True)
class Pattern:
    """context: an expression that, within 20 characters of a match, adds 0.2 to the confidence. words: where told, every match begins with one of them."""

    kind: str
    pattern: str
    confidence: float = 0.9
    context: str | None = None
    words: tuple[str, ...] = ()


SPANS = "array<struct<start:int,end:int,kind:string,confidence:double,found:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("confidence", pa.float64()), ("found", pa.string())]))
#: A context counts within so many characters of a match.
NEAR = 20


def _each(kind: pa.DataType, f: Callable, *columns: pa.Array) -> pa.Array:
    return pa.array([f(*(v.as_py() for v in row)) for row in zip(*columns)], kind)


def _placed(x: str, p: Pattern, found: list[str], gaps: list[int]) -> Iterator[dict]:
    """Matches with their offsets: gaps are the lengths of what lies between them."""
    at = 0
    for m, gap in zip(found, gaps):
        start = at + gap
        at = start + len(m)
        sure = p.confidence
        if p.context is not None and re.search(p.context, x[max(0, start - NEAR) : at + NEAR], re.IGNORECASE):
            sure = min(1.0, p.confidence + 0.2)
        yield {"start": start, "end": at, "kind": p.kind, "confidence": sure, "found": m}


def all_spans(x: Column, patterns: tuple[Pattern, ...]) -> Column:
    """Spans of all patterns by start, the surer first, then by kind; those of one pattern don't overlap. start counts from 0, end is exclusive; a null text has none."""

    def merged(text: str | None, *lists: list) -> list[dict]:
        every = [s for i, p in enumerate(patterns) for s in _placed(text, p, lists[2 * i] or [], lists[2 * i + 1] or [])]
        return sorted(every, key=lambda s: (s["start"], -s["confidence"], s["kind"]))

    @F.arrow_udf(SPANS)
    def of(text: pa.Array, *lists: pa.Array) -> pa.Array:
        return _each(_SPANS, merged, text, *lists)

    found = [F.regexp_extract_all(x, F.lit(p.pattern), F.lit(0)) for p in patterns]
    # only texts with a match are gone through once more
    gaps = [F.when(F.size(f) > 0, F.transform(F.split(x, p.pattern, -1), F.length)) for f, p in zip(found, patterns)]
    return of(x, *[c for pair in zip(found, gaps) for c in pair])


def matches(text: str, p: Pattern) -> Iterator[re.Match]:
    """Matches of a pattern that reads the same in Python, leftmost first, not overlapping; where its words are told, only their places are tried."""
    expression = re.compile(p.pattern)
    if not p.words:
        yield from expression.finditer(text)
        return
    places, end = set(), 0
    for w in p.words:
        at = text.find(w)
        while at >= 0:
            places.add(at)
            at = text.find(w, at + 1)
    for at in sorted(places):
        if at >= end and (m := expression.match(text, at)):
            end = m.end()
            yield m


def spans(x: Column, p: Pattern) -> Column:
    """All matches, leftmost first, not overlapping."""
    return all_spans(x, (p,))


def _kept(pick: Callable[[list[dict]], list[dict]], given: Column) -> Column:
    @F.arrow_udf(SPANS)
    def of(lists: pa.Array) -> pa.Array:
        return _each(_SPANS, lambda v: None if v is None else pick(v), lists)

    return of(given)


def resolved(sorted_spans: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for s in sorted_spans:
        if not kept or s["start"] >= kept[-1]["end"]:
            kept.append(s)
    return kept


def resolve(sorted_spans: Column) -> Column:
    """Those that begin before the end of one that was kept are left out."""
    return _kept(resolved, sorted_spans)


def longest_first(every: Column) -> Column:
    """Longer spans are kept first, at one length those that begin first; those that overlap a kept one are left out."""

    def pick(given: list[dict]) -> list[dict]:
        kept: list[dict] = []
        ends: list[tuple[int, int]] = []  # of kept spans, which don't overlap, in order
        for s in sorted(given, key=lambda s: (s["start"] - s["end"], s["start"])):
            i = bisect_left(ends, (s["end"], -1))
            if (i == 0 or ends[i - 1][1] <= s["start"]) and (i == len(ends) or ends[i][0] >= s["end"]):
                kept.append(s)
                insort(ends, (s["start"], s["end"]))
        return kept

    return _kept(pick, every)


STRATEGIES = {
    "mask": lambda s: F.concat(F.repeat(F.lit("*"), F.when(F.length(s["found"]) <= 4, F.length(s["found"])).otherwise(F.length(s["found"]) - 4)), F.when(F.length(s["found"]) > 4, F.right(s["found"], F.lit(4))).otherwise("")),
    "replace": lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in PLACEHOLDERS.items() for v in pair]), s["kind"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
    "remove": lambda s: F.lit(""),
    "encode": lambda s: F.concat(F.lit("[ENC:"), F.base64(s["found"].cast("binary")), F.lit("]")),
    "annotate": lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit(":"), s["found"], F.lit("]")),
    "hash": lambda s: F.concat(F.lit("[HASH:"), F.substring(F.sha2(s["found"], 256), 1, 16), F.lit("]")),
}


def redact(x: Column, kept: Column, strategy: str) -> Column:
    """The text with each span (by start, not overlapping) put by what the strategy makes of it."""

    def put(text: str | None, starts: list[int] | None, ends: list[int], pieces: list[str]) -> str | None:
        if text is None or starts is None:
            return None
        out, at = [], 0
        for start, end, piece in zip(starts, ends, pieces):
            out += [text[at:start], piece]
            at = end
        return "".join(out) + text[at:]

    @F.arrow_udf("string")
    def of(text: pa.Array, *lists: pa.Array) -> pa.Array:
        return _each(pa.string(), put, text, *lists)

    return of(x, F.transform(kept, lambda s: s["start"]), F.transform(kept, lambda s: s["end"]), F.transform(kept, STRATEGIES[strategy]))


def confidence(match: Column, context: Column, specific: Column) -> Column:
    return match * 0.5 + context * 0.3 + specific * 0.2


def marked_parts(x: Column, pattern: str) -> Column:
    """Parts of a text that begin at a mark (a match of pattern), the mark included, trimmed; what lies before the first comes first, unless it is blank."""
    strip = lambda t: F.regexp_replace(t, r"^[\t-\r ]+|[\t-\r ]+$", "")
    # the part before the first mark has none; gaps are an argument here: written out in the function, a text would be split again for each of its marks
    marks = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
    parts = F.zip_with(marks, F.split(x, pattern, -1), lambda m, gap: F.struct(F.when(m.isNull(), "preamble").otherwise("part").alias("kind"), strip(F.concat(F.coalesce(m, F.lit("")), gap)).alias("part")))
    return F.filter(parts, lambda p: (p["kind"] == "part") | (p["part"] != ""))


def packed(sentences: Column, most: int) -> Column:
    """Sentences joined by blanks into chunks, as many as fit in `most` characters (blanks not counted); a longer one stands alone."""

    def chunks(given: list[str] | None) -> list[str] | None:
        if given is None:
            return None
        out: list[list[str]] = []
        size = 0
        for s in given:
            if out and size + len(s) <= most:
                out[-1].append(s)
                size += len(s)
            else:
                out.append([s])
                size = len(s)
        return [" ".join(c) for c in out]

    @F.arrow_udf("array<string>")
    def of(lists: pa.Array) -> pa.Array:
        return _each(pa.list_(pa.string()), chunks, lists)

    return of(sentences)


def completeness(x: Column) -> Column:
    """1 for a text that ends a sentence, .5 for one that ends at a comma or colon, else .3; 0 for a blank one."""
    last = F.right(F.rtrim(x, F.lit("\t\n\v\f\r ")), F.lit(1))
    return F.when(last == "", 0.0).when(last.isin(".", "!", "?"), 1.0).when(last.isin(",", ";", ":"), 0.5).otherwise(0.3)


def coherence(x: Column, connectives: tuple[str, ...]) -> Column:
    """.9 for a share of 0.05 to 0.15 of connectives met over words, .6 below, .7 above."""
    # a sum and no lambda, in which the text would be put in lower case again for each of them
    met = sum((F.when(F.contains(F.lower(x), F.lit(c)), 1).otherwise(0) for c in connectives), F.lit(0))
    share = met / F.greatest(F.regexp_count(x, F.lit(r"[^\t-\r ]+")), F.lit(1))
    return F.when(share.between(0.05, 0.15), 0.9).when(share < 0.05, 0.6).otherwise(0.7)
