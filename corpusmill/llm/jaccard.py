"""Near duplicates: exact Jaccard join of word-shingle sets.

Method: documents are put in size bands and, within a band, in tiles; in a tile,
hashed bitmap signatures bound the overlap of two sets from above (each element
that only one set has flips at most one bit), and only pairs that the bound lets
pass are intersected, as sorted arrays.

Which documents share a tile. Two sets of n and m elements that link have at
least percent of n, and of m, in common, so under one order of all elements each
has a common element among its first n - ceil(percent n / 100) + 1: those are a
document's keys. The order is by a sketch of how many documents hold an element,
rarest first: a fixed number of counters, added up over all documents, so that
lines and passages that many documents share are hardly ever keys. The sketch
decides only which documents are compared, never whether they link.

Documents of sizes that can link, joined by keys, directly or through others, form
clusters; a cluster is one tile, or beyond TILE_SETS sets a grid of tiles over its
size bands. Clusters beyond GRID_TILES tiles (where the sketch tells little apart)
are not trusted: of the documents that share a key the smallest leads, each document
is in the tile of the lead with which it shares most keys, groups beyond a tile are
dealt over several, the lead in each, and dealt anew, and then only groups in which
verified links leave more than one component go through tiles again, those apart
from their lead against all others. No pair of documents is ever a row: tiles return
the edges of their own spanning forest.

Defined results: null and empty texts, and texts of white space, have no
shingles and are linked with nothing; texts of fewer than k words have their
whole word sequence as one shingle; rows that repeat a doc_id are one vertex;
rows without doc_id keep a null component; an empty table gives an empty one;
other columns are not read. Equal sets are one class throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H
from corpusmill.llm.components import connected_components, told
from corpusmill.session import durable

SHINGLE_WORDS = 5
PERCENT = 80
TILE_SETS = 1024
TILE_SHINGLES = 1 << 21
#: Counters of the sketch, of a byte each, and the pages in which tasks hand them on.
SLOTS, PAGES = 1 << 23, 64
SLOT_SHIFT = np.uint64(64 - 23)
#: Clusters of more tiles than this go through leads instead of a grid.
GRID_TILES = 64
#: Ids of sets to look up are broadcast up to this number; beyond it the lookup is a shuffled join.
BROADCAST_IDS = 500_000
#: Clusters beyond one tile, with their bands (some tens of numbers), are broadcast up to this number; beyond it they meet documents by a salted key.
BROADCAST_CLUSTERS, SALTS = 10_000, 64


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    for _, data, offsets in H.chunks(column):
        hashed, counts = H.shingles(*H.words(data, offsets), k)
        at = 0
        for n in counts:
            own = np.sort(hashed[at : at + n])
            at += n
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if n > 1 else own


def least_size(percent: int) -> int:
    """Sets with fewer elements link with equal ones only."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 40


def keys(own: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The rarest elements of a set, so many that sets that link have one of them in common."""
    n = len(own)
    if n < least_size(percent):
        return np.zeros(0, np.uint64)
    first = n + percent * n // -100 + 1
    place = (sketch[own >> SLOT_SHIFT].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
    return own[np.argpartition(place, first - 1)[:first]]


def _tally(k: int):
    """text -> (page, counters): in how many of a task's documents an element of each slot occurs, up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint8)
        for b in batches:
            for own in sets_of(b.column(0), k):
                slots = own >> SLOT_SHIFT
                counts[slots] += counts[slots] < 255
        pages = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PAGES)]
        yield pa.record_batch([pa.array(range(PAGES), pa.int32()), pa.array(pages, pa.binary())], ["page", "counts"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, counters) sorted by page -> one row for each page, eight steps for each power of two."""

    def row(page: int, total: np.ndarray) -> pa.RecordBatch:
        steps = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
        return pa.record_batch([pa.array([page], pa.int32()), pa.array([steps.tobytes()], pa.binary())], ["page", "counts"])

    at, total = None, None
    for b in batches:
        for page, counts in zip(b.column(0).to_pylist(), b.column(1)):
            if page != at:
                if at is not None:
                    yield row(at, total)
                at, total = page, np.zeros(SLOTS // PAGES, np.int64)
            total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
    if at is not None:
        yield row(at, total)


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """The sketch of all documents (column text): SLOTS bytes, whatever the number of documents."""
    pages = docs.select("text").mapInArrow(_tally(k), "page int, counts binary").repartition("page").sortWithinPartitions("page")
    out = np.zeros((PAGES, SLOTS // PAGES), np.uint8)
    for r in pages.mapInArrow(_total, "page int, counts binary").collect():
        out[r.page] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def _describe(k: int):
    """doc_id, text -> doc_id, size, two sums that name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = np.array([_name(own) for own in sets_of(b.column(1), k)], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.record_batch([b.column(0), *[pa.array(named[:, i]) for i in range(3)]], ["doc_id", "n", "a", "b"])

    return run


def _name(own: np.ndarray) -> tuple[int, int, int]:
    return len(own), int(own.sum(dtype=np.uint64)), int(H.mix(own ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))


def _keys(k: int, percent: int, sketch):
    """doc_id, text -> (key, n, doc_id), a row for each key; of equal sets in a task only the first has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int, int]] = set()
        order = sketch.value
        for b in batches:
            found, sizes = [np.zeros(0, np.uint64)], []
            for own in sets_of(b.column(1), k):
                name = _name(own)
                if len(met) >= 1 << 20:
                    met.clear()
                found.append(own[:0] if name in met else keys(own, order, percent))
                sizes.append(len(own))
                met.add(name)
            times = [len(x) for x in found[1:]]
            owner = np.repeat(b.column(0).to_numpy(zero_copy_only=False), times)
            flat = np.concatenate(found).view(np.int64)
            yield pa.record_batch([pa.array(flat), pa.array(np.repeat(np.array(sizes, np.int32), times), pa.int32()), pa.array(owner, pa.int64())], ["key", "n", "doc_id"])

    return run


def _meet(percent: int):
    """Rows (key, n, doc_id) sorted so -> (lead, doc_id, shared): the first document of a key, or after a gap that no link spans, and each other one, with the number of such keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n, first = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            key, n, doc = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            before = np.concatenate(([last_n], n[:-1]))
            fresh = np.concatenate(([key[0] != last], key[1:] != key[:-1])) | (percent * n > 100 * before)
            lead = np.concatenate(([first], doc[fresh]))[np.cumsum(fresh)]
            last, last_n, first = key[-1], n[-1], lead[-1]
            apart = lead != doc
            pairs = pa.table({"lead": lead[apart], "doc_id": doc[apart]}).group_by(["lead", "doc_id"]).aggregate([([], "count_all")])
            yield from pairs.select(["lead", "doc_id", "count_all"]).rename_columns(["lead", "doc_id", "shared"]).combine_chunks().to_batches()

    return run


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """Words of a signature: a bit is flipped by each element that it stands for."""
    flips = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def link(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets, those of one label taken as linked; side 0 and 1: only pairs across are looked at, -1: all pairs."""
    order = np.argsort(sizes, kind="stable")
    n, side = sizes[order], side[order]
    count = len(n)
    bits = 64
    while bits < 2 * int(np.median(n)) and bits < 1 << 13:
        bits *= 2
    maps = np.zeros((count, bits // 64), np.uint64)
    for row, i in enumerate(order):
        maps[row] = bitmap(sets[i], bits)
    root = np.arange(count) if label is None else np.unique(label[order], return_inverse=True)[1]
    found = []
    for i in range(count - 1):
        end = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
        rest = np.arange(i + 1, end)
        rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (side[i] < 0))]
        if not len(rest):
            continue
        differ = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        most = (n[rest] + n[i] - differ) // 2
        for j in rest[(100 + percent) * most >= percent * (n[rest] + n[i])]:
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                found.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return found


def _tiles(percent: int):
    """Rows (tile, side, label, doc_id, shingles), sorted by tile -> edges of each tile's forest."""

    def solve(rows: list) -> list[tuple[int, int]]:
        docs = [r[2] for r in rows]
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        found = link(np.array([len(s) for s in sets]), sets, np.array([r[0] for r in rows]), percent, np.array([r[1] for r in rows]))
        return [(docs[i], docs[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for b in batches:
            out = []
            for t, *row in zip(*(c.to_pylist() for c in b.columns)):
                if t != tile:
                    out += solve(rows) if len(rows) > 1 else []
                    tile, rows = t, []
                rows.append(row)
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])
        out = solve(rows) if len(rows) > 1 else []
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return run


def _grid(members: DataFrame, percent: int, tile_sets: int) -> DataFrame:
    """doc_id, n, cluster -> tile, side, label, doc_id: one tile for a small cluster, else cells of its size bands, paired."""
    # fine bands: sets that link are in the same or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent) * 1.0001)))
    cells = (
        members.withColumn("band", band)
        .groupBy("cluster", "band")
        .agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        .withColumn("cells", F.greatest(F.ceil(F.col("c") / tile_sets), F.ceil(F.col("s") / TILE_SHINGLES)).cast("int"))
    )
    whole = cells.groupBy("cluster").agg(F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.map_from_entries(F.collect_list(F.struct("band", "cells"))).alias("of"))
    # only clusters beyond one tile need their bands, and those are few: no document is dealt by its cluster
    large = durable(whole.filter((F.col("all_c") > tile_sets) | (F.col("all_s") > TILE_SHINGLES)).select(F.col("cluster").alias("large"), "of"))
    near = lambda b: F.coalesce(F.element_at("of", b), F.lit(0))
    banded = members.withColumn("band", band)
    if large.count() <= BROADCAST_CLUSTERS:
        spot = banded.join(F.broadcast(large), F.col("cluster") == F.col("large"), "left")
    else:
        salted = large.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        spot = banded.join(salted, (F.col("cluster") == F.col("large")) & (spread == F.col("salt_")), "left")
    own = near(F.col("band"))
    cell = F.pmod(F.xxhash64("doc_id"), F.greatest(own, F.lit(1)))
    name = lambda *x: F.concat_ws("/", F.col("cluster").cast("string"), *[y.cast("string") for y in x])
    upto = lambda hi: F.when(hi > 0, F.sequence(F.lit(0), hi - 1)).otherwise(F.array().cast("array<int>"))
    b = F.col("band")
    same = F.transform(
        upto(own.cast("int")),
        lambda j: F.struct(
            name(b, F.least(j, F.col("cell")), b, F.greatest(j, F.col("cell"))).alias("tile"),
            F.when(j == F.col("cell"), -1).when(j > F.col("cell"), 0).otherwise(1).alias("side"),
        ),
    )
    above = F.transform(upto(near(b + 1).cast("int")), lambda j: F.struct(name(b, F.col("cell"), b + 1, j).alias("tile"), F.lit(0).alias("side")))
    below = F.transform(upto(near(b - 1).cast("int")), lambda j: F.struct(name(b - 1, j, b, F.col("cell")).alias("tile"), F.lit(1).alias("side")))
    one = F.array(F.struct(name().alias("tile"), F.lit(-1).alias("side")))
    return (
        spot.withColumn("cell", cell.cast("int"))
        .select("doc_id", F.explode(F.when(F.col("large").isNull(), one).otherwise(F.concat(same, above, below))).alias("t"))
        .select("t.tile", "t.side", F.col("doc_id").alias("label"), "doc_id")
    )


def _cells(count: Column, shingles: Column, tile_sets: int) -> Column:
    """Into how many parts a group is dealt."""
    return F.greatest(F.ceil(count / tile_sets), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _cell(cells: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.greatest(cells, F.lit(1))).cast("int")


def _name_of(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts]).alias("tile")


def _near_leads(led: DataFrame, tile_sets: int) -> tuple[DataFrame, DataFrame]:
    """First pass: lead, doc_id, shared, n -> tile, side, label, doc_id: each document with the lead it shares most keys with; and groups beyond a tile dealt anew."""
    best = durable(led.groupBy("doc_id", "n").agg(F.max_by("lead", F.struct("shared", -F.col("lead"))).alias("lead")))
    groups = durable(best.groupBy("lead").agg(_cells(F.count("*"), F.sum("n"), tile_sets).alias("cells")))

    def dealt(of: DataFrame, seed: int) -> DataFrame:
        cell = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("cells"))
        placed = told(best, of, ["lead"], "doc_id").select(_name_of(F.col("lead"), cell), "doc_id")
        leads = of.select(F.col("lead").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).select(_name_of(F.col("doc_id"), F.col("cell")), "doc_id")
        return placed.unionByName(leads).distinct().select("tile", F.lit(-1).alias("side"), F.col("doc_id").alias("label"), "doc_id")

    return dealt(groups, 0), dealt(groups.filter("cells > 1"), 1)


def _apart(led: DataFrame, labels: DataFrame, tile_sets: int) -> DataFrame:
    """Second pass: groups with documents that no verified links join with their lead -> tile, side, label, doc_id; those against each other and all others."""
    own = labels.select(F.col("doc_id"), F.col("label"))
    marked = led.join(own, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    marked = told(marked, labels.select(F.col("doc_id").alias("lead"), F.col("label").alias("of_lead")), ["lead"], "doc_id", "left").withColumn("of_lead", F.coalesce("of_lead", "lead"))
    far = F.col("label") != F.col("of_lead")
    split = marked.select("lead", "doc_id", "n", "label", "of_lead", far.alias("far"))
    groups = (
        split.groupBy("lead")
        .agg(F.count_if("far").alias("c"), F.sum(F.when(F.col("far"), F.col("n"))).alias("s"), F.count_if(~F.col("far")).alias("d"), F.sum(F.when(~F.col("far"), F.col("n"))).alias("t"), F.max("of_lead").alias("lead_label"), F.max("n").alias("most"))
        .filter("c > 0")
        .select("lead", "lead_label", _cells(F.col("c"), F.col("s"), tile_sets).alias("far_cells"), _cells(F.col("d") + 1, F.coalesce("t", F.lit(0)) + F.col("most"), tile_sets).alias("near_cells"))
    )
    groups = durable(groups)
    leads = groups.select("lead", F.col("lead").alias("doc_id"), F.col("lead_label").alias("label"), F.lit(False).alias("far"), "far_cells", "near_cells")
    rows = told(split, groups.drop("lead_label"), ["lead"], "doc_id").select(*leads.columns).unionByName(leads)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine = _cell(F.col("far_cells"))
    among = F.transform(
        upto(F.col("far_cells")),
        lambda j: F.struct(_name_of(F.col("lead"), F.least(j, mine), F.greatest(j, mine)), F.when(j == mine, -1).when(j > mine, 0).otherwise(1).alias("side")),
    )
    across = F.transform(upto(F.col("near_cells")), lambda j: F.struct(_name_of(F.col("lead"), mine, F.lit("n"), j), F.lit(0).alias("side")))
    others = F.transform(upto(F.col("far_cells")), lambda i: F.struct(_name_of(F.col("lead"), i, F.lit("n"), _cell(F.col("near_cells"))), F.lit(1).alias("side")))
    return rows.select("doc_id", "label", F.explode(F.when(F.col("far"), F.concat(among, across)).otherwise(others)).alias("t")).select("t.tile", "t.side", "label", "doc_id").distinct()


def _links(given: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v) of the forests of all tiles; sets are made again from the texts of the documents that tiles hold."""
    wanted = placed.select(F.col("doc_id").alias("wanted")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = given.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in sets_of(b.column(1), k)], pa.binary())], ["doc_id", "shingles"])

    # rows that repeat a doc_id with other texts: each keeps its own set
    found = texts.mapInArrow(arrays, "doc_id long, shingles binary")
    tiles = placed.join(found, "doc_id").select("tile", "side", "label", "doc_id", "shingles")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(percent), "u long, v long")


def meetings(given: DataFrame, k: int, percent: int) -> DataFrame:
    """lead, doc_id, shared (keys): every two sets that link, and are not equal, are in one group of a lead, itself included."""
    sketch = given.sparkSession.sparkContext.broadcast(rarity(given, k))
    # keys are several times the size of what names a set: they are made from the texts again rather than kept
    rows = given.filter("doc_id is not null").mapInArrow(_keys(k, percent, sketch), "key long, n int, doc_id long")
    met = rows.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_meet(percent), "lead long, doc_id long, shared long")
    return durable(met.groupBy("lead", "doc_id").agg(F.sum("shared").alias("shared")))


def _leads(met: DataFrame, own: DataFrame, within: DataFrame) -> DataFrame:
    """lead, doc_id (classes), shared, n (of doc_id) of what meets among the documents (doc_id) of within."""
    classes = own.select(F.col("doc_id").alias("id"), "n", "rep")
    some = met.join(within, "doc_id", "left_semi").join(classes, F.col("doc_id") == F.col("id")).select("lead", F.col("rep").alias("doc_id"), "shared", "n")
    ahead = told(some, classes.select(F.col("id").alias("lead"), F.col("rep").alias("lead_rep")), ["lead"], "doc_id")
    return ahead.filter("lead_rep <> doc_id").groupBy(F.col("lead_rep").alias("lead"), "doc_id", "n").agg(F.sum("shared").alias("shared"))


def _large(given: DataFrame, led: DataFrame, k: int, percent: int, tile_sets: int) -> DataFrame:
    """Edges (u, v) of very large clusters, closed over verified links only."""
    led = durable(led)
    first, again = _near_leads(led, tile_sets)
    links = durable(_links(given, durable(first), k, percent))
    known = connected_components(links).toDF("doc_id", "known")
    again = durable(again.join(known, "doc_id", "left").select("tile", "side", F.coalesce("known", "label").alias("label"), "doc_id"))
    links = links.union(_links(given, again, k, percent))
    near = durable(connected_components(links).toDF("doc_id", "label"))
    return near.toDF("u", "v").union(_links(given, durable(_apart(led, near, tile_sets)), k, percent))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT, tile_sets: int = TILE_SETS
) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to.

    Two documents link when 100 |A and B| >= percent |A or B| for their sets of
    distinct k-word shingles. One row for each row of docs.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = durable(given.mapInArrow(_describe(k), "doc_id long, n long, a long, b long"))
    named = described.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    own = durable(told(named, classes, ["n", "a", "b"], "doc_id").select("doc_id", "n", "rep"))

    met = meetings(given, k, percent)
    clusters = connected_components(met.toDF("u", "v", "shared").select("u", "v")).toDF("doc_id", "cluster")
    members = durable(clusters.join(own, "doc_id").select("cluster", F.col("doc_id").alias("id"), F.col("rep").alias("doc_id"), "n"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    large = durable(sizes.filter((F.col("c") > GRID_TILES * tile_sets) | (F.col("s") > GRID_TILES * TILE_SHINGLES)).select("cluster"))
    if large.isEmpty():
        links = _links(given, durable(_grid(members.select("cluster", "doc_id", "n").distinct(), percent, tile_sets)), k, percent)
    else:
        small, big = members.join(F.broadcast(large), "cluster", "left_anti"), members.join(F.broadcast(large), "cluster", "left_semi")
        links = _links(given, durable(_grid(small.select("cluster", "doc_id", "n").distinct(), percent, tile_sets)), k, percent)
        links = links.union(_large(given, _leads(met, own, big.select(F.col("id").alias("doc_id"))), k, percent, tile_sets))
    # a doc_id of rows with several sets holds the classes of those sets together
    several = own.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("u"))
    tied = own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).join(several, "u", "left_semi")
    ends = connected_components(links.union(tied)).toDF("rep", "component")
    final = (
        told(own, ends, ["rep"], "doc_id", "left")
        .select("doc_id", F.coalesce("component", "rep").alias("component"))
        .groupBy("doc_id")
        .agg(F.min("component").alias("component"))
        .withColumnRenamed("doc_id", "id")
    )
    return described.join(final, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents of docs that have the smallest id of their group, those without words, and rows without id; rows that repeat an id are one document."""
    gone = f"gone_{'_'.join(docs.columns)}"  # no column has this name
    groups = near_duplicates(docs, id_col=id_col, **how).filter("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    if groups.count() <= BROADCAST_IDS:
        groups = F.broadcast(groups)
    return docs.join(groups, docs[id_col] == F.col(gone), "left_anti")
