"""Articles of two versions matched one to one: by number, by equal content, and by likeness.

Equal contents are matched in the order of their numbers, so many copies of one article
are no block of pairs. Of the rest of a document's articles every old one is held against
every new one: a document is dealt over tiles (a part of its old articles and a part of its
new ones), and a pair is only left uncompared where its lengths, or the longest
subsequence of characters that both texts have, don't allow the likeness asked for. Pairs
are then taken greedily: a document's pairs come to one task in their order (likeness,
then numbers), which keeps only the numbers of the document's matched articles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.matching import LONG, Held, common, matching_blocks, places, ratio, shared
from corpusmill.session import durable

#: Least likeness of two articles, and what a title and numbers of one kind add at most; fixed values.
LEAST, TITLE, NUMBER = 0.6, 0.1, 0.1
KEYS = 8
PREFIXES = ("Ek Madde", "Geçici Madde")
#: A side of a tile has articles of so much weight, about: each weighs one, and one more for so many characters.
TILE, CHARACTERS = 512, 512
#: What rounding may take from a bound.
ROUNDING = 1e-9
#: Rows of pairs given out at once.
ROWS = 10_000


def number_kind(number: Column) -> Column:
    """Articles are numbered plainly, or as one of two kinds of additions."""
    kind = F.lit("plain")
    for p in reversed(PREFIXES):
        kind = F.when(F.contains(number.cast("string"), F.lit(p)), p).otherwise(kind)
    return kind


def run_keys(content: Column, most: int = KEYS) -> Column:
    """The least hashes of runs of three words; match_articles compares all pairs and has no use for them."""

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(3)), " ")))
        return F.when(F.size(words) < 3, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(each)

    # words are a variable of the outer function: written out in the inner one, a text would be split again for each of its runs
    words = F.regexp_extract_all(F.lower(content), F.lit(r"[^\t-\r ]+"), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(F.get(F.transform(F.array(words), runs), 0))), 1, most)


def greedy(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs (key, old_, new_, likeness, ratio) that greedy one-to-one matching takes."""
    at = [pairs.columns.index(c) for c in (key, "old_", "new_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, olds, news = None, set(), set()
        for b in batches:
            keep = []
            for k, old, new in zip(*(b.column(i).to_pylist() for i in at)):
                if k != now:
                    now, olds, news = k, set(), set()
                free = old not in olds and new not in news
                if free:
                    olds.add(old)
                    news.add(new)
                keep.append(free)
            yield b.filter(pa.array(keep, pa.bool_()))

    in_turn = pairs.repartition(key).sortWithinPartitions(key, F.desc("likeness"), F.desc("ratio"), "old_", "new_")
    return in_turn.mapInArrow(run, pairs.schema)


OLD, NEW = 0, 1


def _copies(rest: DataFrame) -> DataFrame:
    """(key_, side, n, weight, other): other is the number of the article on the other side that has the same content, the first with the first and so on."""
    rows = rest.select("key_", "side", "n", F.sha2("c", 256).alias("h"), (1 + F.length("c") / CHARACTERS).alias("weight")).repartition("key_", "h")
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("key_", "h", "side").orderBy("n")))
    turn = W.partitionBy("key_", "h", "copy").orderBy("side")
    return rows.select("key_", "side", "n", "weight", F.when(F.col("side") == OLD, F.lead("n").over(turn)).otherwise(F.lag("n").over(turn)).alias("other"))


def _tiles(met: DataFrame) -> DataFrame:
    """(key_, side, n, part, parts): the part of its side that an article without a copy is in, and how many the other side of its document has."""
    left = met.repartition("key_").groupBy("key_", "side", "n").agg(F.sum("weight").alias("weight"), F.max(F.col("other").isNotNull()).alias("matched")).filter("not matched")
    before = F.sum("weight").over(W.partitionBy("key_", "side").orderBy("n").rowsBetween(W.unboundedPreceding, 0)) - F.col("weight")
    left = left.withColumn("part", F.floor(before / TILE).cast("int"))
    last = lambda side: F.max(F.when(F.col("side") == side, F.col("part"))).over(W.partitionBy("key_"))
    parts = F.when(F.col("side") == OLD, last(NEW)).otherwise(last(OLD)) + 1
    return left.select("key_", "side", "n", "part", parts.alias("parts")).filter("parts is not null")


class _Text:
    """What articles of one content, title and kind of number have in common."""

    def __init__(self, kind: str, title: str, content: str):
        self.kind, self.title, self.content, self.numbers, self.places, self.held = kind, title, content, [], None, None


def _likeness(old: _Text, new: _Text, least: float) -> tuple[float, float] | None:
    """(likeness, ratio) of two texts, or none where it is below least."""
    number = NUMBER if old.kind == new.kind else 0.0
    titled = old.title != "" and new.title != ""
    x, y = len(old.content), len(new.content)
    # blocks of x and y characters hold twice the smaller at most, and no more than the longest common subsequence
    needed = (least - number - (TITLE if titled else 0.0) - ROUNDING) * (x + y)
    if 2 * min(x, y) < needed:
        return None
    # a long text has few anchors, and its blocks are found as soon
    if y < LONG:
        if old.places is None:
            old.places = places(old.content)
        if 2 * common(old.places, x, new.content) < needed:
            return None
    if new.held is None:
        new.held = Held(new.content)
    blocks = shared(old.content, new.held, needed / 2)
    if blocks is None:
        return None
    share = 2.0 * blocks / (x + y) if x + y else 1.0
    titles = ratio(matching_blocks(old.title, new.title)) if titled else 0.0
    likeness = min(1.0, share + TITLE * titles + number)
    return (likeness, share) if likeness >= least else None


def alike(rest: DataFrame, least: float) -> DataFrame:
    """(key_, old_, new_, likeness, ratio) of every old and new article of a key that are least alike; one task has a tile's old articles, and its new ones pass by."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rest.select("key_", "side", "n", number_kind(F.col("n")).alias("kind"), F.lower("t").alias("t"), F.lower("c").alias("c"), "part", other.alias("other"))
    at = lambda side: F.when(F.col("side") == side, F.col("part")).otherwise(F.col("other"))
    rows = rows.select("key_", at(OLD).alias("i"), at(NEW).alias("j"), "side", "n", "kind", "t", "c")
    key, number = rows.schema["key_"].dataType, rows.schema["n"].dataType
    pairs = T.StructType().add("key_", key).add("old_", number).add("new_", number).add("likeness", "double").add("ratio", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, olds, known, out, schema = None, {}, {}, [], None

        def given() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            if schema is None:
                number = b.schema.field("n").type
                schema = pa.schema([("key_", b.schema.field("key_").type), ("old_", number), ("new_", number), ("likeness", pa.float64()), ("ratio", pa.float64())])
            for key, i, j, side, n, *text in zip(*(c.to_pylist() for c in b.columns)):
                if (key, i, j) != now:
                    now, olds, known = (key, i, j), {}, {}
                text = tuple(text)
                if side == OLD:
                    olds.setdefault(text, _Text(*text)).numbers.append(n)
                    continue
                if text not in known:
                    new = _Text(*text)
                    known[text] = [(old, found) for old in olds.values() if (found := _likeness(old, new, least))]
                for old, found in known[text]:
                    for o in old.numbers:
                        out.append((key, o, n, *found))
                        if len(out) == ROWS:
                            yield given()
        if out:
            yield given()

    # a given number of tasks: tiles are few bytes for their work, and would be put together by size
    width = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_turn = rows.repartition(width, "key_", "i", "j").sortWithinPartitions("key_", "i", "j", "side")
    return in_turn.mapInArrow(run, pairs)


def match_articles(old: DataFrame, new: DataFrame, key: str, number: str = "number", title: str = "title", content: str = "content", least: float = LEAST) -> DataFrame:
    """key, old_number, new_number, how (number, content, likeness), likeness: a row for each matched pair.

    old and new have a row for each article of a document (key, number, title, content);
    the pair of a null number or content is not found by likeness.
    """
    shape = lambda df: df.select(F.col(key).alias("key_"), F.col(number).alias("n"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(content), F.lit("")).alias("c")).filter(F.col("key_").isNotNull() & F.col("n").isNotNull())
    a, b = shape(old), shape(new)
    by_number = a.select("key_", "n").join(b.select("key_", "n"), ["key_", "n"]).select("key_", F.col("n").alias("old_"), F.col("n").alias("new_"), F.lit("number").alias("how"), F.lit(None).cast("double").alias("likeness"))
    rest_of = lambda df, other, side: df.join(other.select("key_", "n"), ["key_", "n"], "left_anti").select("key_", F.lit(side).alias("side"), "n", "t", "c")
    rest = durable(rest_of(a, b, OLD)).unionByName(durable(rest_of(b, a, NEW)))
    met = durable(_copies(rest))
    by_content = met.filter(F.col("other").isNotNull() & (F.col("side") == OLD)).select("key_", F.col("n").alias("old_"), F.col("other").alias("new_"), F.lit("content").alias("how"), F.lit(1.0).alias("likeness"))
    pairs = alike(rest.join(_tiles(met), ["key_", "side", "n"]), least)
    by_likeness = greedy(pairs, "key_").select("key_", "old_", "new_", F.lit("likeness").alias("how"), "likeness")
    return by_number.unionByName(by_content).unionByName(by_likeness).select(F.col("key_").alias(key), F.col("old_").alias("old_number"), F.col("new_").alias("new_number"), "how", "likeness")
