"""References in legal texts and what they point at: "the said article" is the last one named, "the following article" the next.

Mentions are spans of patterns, found in one pass over a text; its references and the
articles and laws that it names are rows by place, and windows over a text carry the last
and the next one named to each reference. A named article or law points at itself.

Defined results: null texts and ids have no references; of overlapping phrases the first
counts, and of those at one place the longer; a reference without an antecedent has a
null target; a kind that can't be told is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import spans

# Words that point back, ahead, and to where one is; what they point at, and how sure that is.
BACKWARD = ("yukarıdaki", "yukarıda", "önceki", "evvelki", "sözü edilen", "söz konusu", "anılan", "mezkûr", "bahsi geçen", "bahsedilen")
FORWARD = ("aşağıdaki", "aşağıda", "takip eden", "izleyen", "sonraki", "müteakip")
INTERNAL = ("bu", "işbu")
KINDS = {"madde": "ARTICLE", "fıkra": "PARAGRAPH", "bent": "SUBPARAGRAPH", "kararname": "DECREE", "karar": "DECISION", "yönetmelik": "REGULATION", "tebliğ": "COMMUNIQUE", "kanun": "LAW"}
SURE = {"backward": 0.85, "forward": 0.80, "internal": 0.90, "article": 0.90, "law": 0.95}
#: White space is written out, as Java and Python don't agree on it.
_GAP = r"[\t-\r ]+"
ARTICLE, LAW = rf"\b[Mm]adde{_GAP}[0-9]+", rf"\b[0-9]{{4}}{_GAP}sayılı(?:(?:{_GAP}[A-ZÇĞİÖŞÜ][a-zçğıöşü]+){{0,3}}?{_GAP}Kanun[a-zçğıöşü]*)?"


def _phrase(words: tuple[str, ...]) -> str:
    """A word that points, up to two words, and a kind."""
    return rf"(?<![a-zçğıöşü])(?:{'|'.join(words)})(?:{_GAP}[a-zçğıöşü]+){{0,2}}?{_GAP}(?:{'|'.join(KINDS)})"


#: The confidence orders phrases at one place; named articles and laws come last.
PATTERNS = (
    spans.Pattern("backward", _phrase(BACKWARD), SURE["backward"], words=BACKWARD), spans.Pattern("forward", _phrase(FORWARD), SURE["forward"], words=FORWARD),
    spans.Pattern("internal", _phrase(INTERNAL), SURE["internal"], words=INTERNAL), spans.Pattern("article", ARTICLE, SURE["article"], words=("Madde", "madde")), spans.Pattern("law", LAW, SURE["law"]),
)
NAMED = ("article", "law")
_MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("found", pa.string()), ("direction", pa.string()), ("confidence", pa.float64()), ("is_ref", pa.int32())]))


def _mentions(text: str | None) -> list[dict]:
    """A text's references (is_ref 1), of which none overlap, and every article and law that it names (0)."""
    if text is None:
        return []
    every = [{"start": m.start(), "end": m.end(), "kind": p.kind, "confidence": p.confidence, "found": m[0]} for p in PATTERNS for m in spans.matches(text, p)]
    every.sort(key=lambda s: (s["start"], -s["confidence"], s["kind"]))
    rows = [(s, 1) for s in spans.resolved(every)] + [(s, 0) for s in every if s["kind"] in NAMED]
    return [{"start": s["start"], "stop": s["end"], "found": s["found"], "direction": s["kind"], "confidence": s["confidence"], "is_ref": r} for s, r in rows]


def kind_of(found: Column) -> Column:
    """What a phrase speaks of: the kind that it ends with, or by what it names."""
    out = F.lit(None).cast("string")
    for word, kind in KINDS.items():
        out = F.coalesce(out, F.when(F.endswith(found, F.lit(word)), kind))
    return out


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop, found, direction (backward, forward, internal, article or law as named), kind, target (number), distance (characters), confidence, and candidates: how many articles or laws the text names on that side."""

    @F.arrow_udf("array<struct<start:int,stop:int,found:string,direction:string,confidence:double,is_ref:int>>")
    def mentions(texts: pa.Array) -> pa.Array:
        return pa.array([_mentions(t) for t in texts.to_pylist()], _MENTIONS)

    # no filter by the text, which is made once more for it where it is an expression
    given = docs.select(F.col(id_col).alias("doc_id"), mentions(F.col(text_col)).alias("every")).filter("doc_id is not null")
    kind = F.when(F.col("direction") == "article", "ARTICLE").when(F.col("direction") == "law", "LAW").otherwise(kind_of(F.col("found")))
    number = F.regexp_extract("found", "[0-9]+", 0).try_cast("long")
    # outer: else a filter of empty arrays is made, which finds all mentions once more
    rows = given.select("doc_id", F.inline_outer("every")).withColumns({"kind": kind, "number": number}).filter("kind is not null")

    # what is named ends before a reference that points back, and begins behind one that points ahead
    ref = F.col("is_ref") == 1
    before = W.partitionBy("doc_id").orderBy(F.when(ref, F.col("start")).otherwise(F.col("stop")), "is_ref", "start").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("doc_id").orderBy(F.when(ref, F.col("stop")).otherwise(F.col("start")).desc(), "is_ref", F.desc("stop")).rowsBetween(W.unboundedPreceding, W.currentRow)
    one = lambda k: F.when(~ref & (F.col("kind") == k), F.struct("number", "start"))
    sides = {"article": ("ARTICLE", before), "law": ("LAW", before), "next": ("ARTICLE", after)}
    carried = rows.withColumns({f"{s}_": F.last(one(k), True).over(w) for s, (k, w) in sides.items()} | {f"{s}_n": F.count(one(k)).over(w) for s, (k, w) in sides.items()}).filter(ref)

    pick = lambda named, ahead, article, law: F.when(F.col("direction").isin(*NAMED), named).when((F.col("direction") == "forward") & (F.col("kind") == "ARTICLE"), ahead).when((F.col("direction") != "forward") & (F.col("kind") == "ARTICLE"), article).when((F.col("direction") == "backward") & (F.col("kind") == "LAW"), law)
    target = pick(F.col("number"), F.col("next_.number"), F.col("article_.number"), F.col("law_.number"))
    distance = pick(F.lit(0), F.col("next_.start") - F.col("start"), F.col("start") - F.col("article_.start"), F.col("start") - F.col("law_.start"))
    candidates = F.coalesce(pick(F.lit(1), F.col("next_n"), F.col("article_n"), F.col("law_n")), F.lit(0))
    return carried.select("doc_id", "start", "stop", "found", "direction", "kind", target.alias("target"), distance.cast("int").alias("distance"), "confidence", candidates.cast("long").alias("candidates"))
