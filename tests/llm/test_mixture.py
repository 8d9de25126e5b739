"""Operators 2 and 3, and the pipeline, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import jaccard, langid, linededup, mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, most):
    """Water-filling by repetition."""
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else rest * weights[s] / w for s in sizes}
        capped |= over


@pytest.mark.parametrize("shape", [(100, 3, 50), (5, 5, 5, 5), (1000, 1, 1, 1, 400), (0, 7), (3,), (0, 0)])
def test_targets_and_takes(spark, shape):
    rows, i = [], 0
    for s, n in enumerate(shape):
        for j in range(max(1, n)):
            rows.append((i, "w " * (j % 5 + 1) if n else None, None if s == 1 else f"s{s}", i))
            i += 1
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    want = fill(sizes, weights, 3) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(words[s] == taken[s] for s in sizes)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == mixing.mixed(docs).count() == 0


def boilerplate(rows, share, least):
    pages, lines = Counter(), defaultdict(Counter)
    for _, t, s in rows:
        pages[s] += 1
        lines[s].update({x for x in (t or "").split("\n") if x.strip(" ")} if t is not None else set())
    bad = {s: {x for x, c in lines[s].items() if c >= min(least, max(pages[s], 3)) and c > share * pages[s]} for s in pages}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad[s]) for _, t, s in rows]


def test_lines(spark):
    rows = [(i, f"menu\nstory {i}\n\n  \nfooter {i % 3}", "a" if i % 4 else None) for i in range(40)]
    rows += [(50, None, "a"), (51, "", "b"), (52, "menu\nmenu", "a"), (52, "menu\nmenu", "a"), (53, "menu", "z"), (54, "long " * 50_000, "a")]
    rows += [(60 + i, f"nav\npage {i}\n" + "other\n" * (i % 3), "of three" if i < 3 else "of two") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "line").repartition(3)
    want = sorted(zip([r[0] for r in rows], map(str, boilerplate(rows, 0.5, 5))))
    for limit in (200_000, 0):
        old, linededup.BROADCAST_LINES = linededup.BROADCAST_LINES, limit
        try:
            got = linededup.drop_boilerplate(docs, most_share=0.5).collect()
        finally:
            linededup.BROADCAST_LINES = old
        assert sorted((r.line, str(r.text)) for r in got) == want
    assert {r.line: r.n_dropped for r in got if r.line >= 60} == {60: 1, 61: 1, 62: 1, 63: 0, 64: 0}
    assert any(r.n_dropped for r in got) and linededup.drop_boilerplate(docs.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [docs]
    for name, stage in p.STAGES:
        stage(spark, outs[-1], SF).write.parquet(str(tmp_path / name))
        outs.append(spark.read.parquet(str(tmp_path / name)))
        if name != p.STAGES[-1][0]:
            assert outs[-1].columns == docs.columns
    given, known, lines, single, mix, ids = (o.collect() for o in outs)
    texts = lambda rows: {r.doc_id: r.text for r in rows}
    lettered = {r.doc_id for r in given if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in known} <= lettered and len(known) >= 0.99 * len(lettered) and all(r.lang for r in known)
    cut = boilerplate([(r.doc_id, r.text, r.source) for r in known], linededup.MOST_SHARE, linededup.LEAST_PAGES)
    assert texts(lines) == {r.doc_id: t for r, t in zip(known, cut)}
    groups = jaccard.near_duplicates(outs[2]).collect()
    assert {r.doc_id for r in single} == {r.doc_id for r in groups if r.component_id == r.doc_id}
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for r in single if (w := WORD.findall(r.text.lower()))}
    left = sorted(shingles)
    for n, a in enumerate(left):
        for b in left[:n]:
            assert len(shingles[a] & shingles[b]) < 0.8 * len(shingles[a] | shingles[b])
    taken = {r.doc_id: r.taken for r in mixing.mix(outs[3]).collect()}
    words = Counter()
    for r in mix:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {i: n for i, n in taken.items() if n} == dict(words)
    tokens = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    want = [(r.doc_id, tokens.encode(r.text or "") + [tokens.eos_id()]) for r in mix]
    assert sorted((r.doc_id, list(r.ids)) for r in ids) == sorted(want)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(r.ids), digest(" ".join(map(str, r.ids))), digest(tokens.decode(list(r.ids)))) for r in ids)
    assert len(p.run(spark, SF).collect()) == len(ids)


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    if rows == "odd":
        odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", None, "a", 5), (None, "the cat sat on the mat", "en", None, 22), (5, "the dog sat on the mat", "en", "b", 22), (5, "the dog sat on the mat", "en", "b", 22), (6, "a b " * 9000, None, "b", 9)]
        docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    clash = ["n", "rep", "tile", "label", "row_", "salt_", "n_dropped", "gone_", "bad_", "host", "u", "slice", "epochs"]
    docs = docs.withColumns({c: F.lit("x") for c in clash})
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = docs.collect()
    assert (not got) == (rows == "none") and {r.doc_id for r in got} <= {None, 5, 6}


def test_long_lists_of_lines_meet_by_salt(spark, monkeypatch):
    rows = [(i, f"menu\nstory number {i}\nfoot {i % 3}", f"h{i % 2}", {"a": i}) for i in range(40)] + [(40, None, None, None), (41, "menu", None, {})] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>").repartition(3)
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(linededup.drop_boilerplate(docs))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert plain(linededup.drop_boilerplate(docs)) == want and any("n_dropped=2" in r for r in want)


def test_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"menu\nstory number {i} of many", "a", 7, "x", "y") for i in range(9)], "doc_id long, text string, source string, n_dropped int, bad_ string, gone_ string")
    cut = linededup.drop_boilerplate(docs, most_share=0.5)
    assert sorted(cut.columns) == sorted(docs.columns) and {r.n_dropped for r in cut.collect()} == {1} and {r.bad_ for r in cut.collect()} == {"x"}
    single = jaccard.one_of_each(docs)
    assert single.columns == docs.columns and single.count() == 9


def test_language_stage_rejects_noise(spark):
    import random

    rnd = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [(10**9 + i, "".join(rnd.choice("qxzjkwvQXZJ?/ ") for _ in range(600)), None, "a", 600) for i in range(20)]
    # one of the texts of noise has a label
    both = docs.unionByName(spark.createDataFrame(noise + [(10**9 - 1, noise[0][1][::-1] * 3, "en", "a", 1800)], docs.schema))
    trees = langid.train(both)
    kept = langid.keep_identified(both, trees, most_bits=langid.usual_bits(both, trees), lang_col="lang")
    assert kept.filter("doc_id >= 1000000000").count() == 0 and kept.filter("lang is null").count() == 0


def test_language_stage_learns_from_all_labelled_texts(spark, monkeypatch):
    """Before, trees and limit came from about 500 documents of a language."""
    import random

    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join("".join(rnd.choice("abcdefgh"[: 2 + i % 7]) for _ in range(rnd.randint(2, 9))) for _ in range(60)), "en") for i in range(1500)], "doc_id long, text string, lang string").repartition(4)
    trees = langid.train(docs, sample_docs=None)
    windows = {int.from_bytes(x[i : i + 4], "big") for r in docs.collect() for x in ["\n\n\n".encode() + r.text.encode()] for i in range(len(x) - 3)}
    assert set(trees.levels[langid.ORDER][0].tolist()) == windows
    ranked = sorted(r.bits for r in langid.identify(docs, trees).collect())
    assert langid.usual_bits(docs, trees) == min(8.0, ranked[int(1500 * langid.USUAL)] * langid.MARGIN)
    monkeypatch.setattr(langid, "_sample", None)
    rows = docs.withColumns({"source": F.lit("a"), "n_chars": F.length("text")})
    assert corpus_pipeline.language(spark, rows, SF).count() == 1500


def test_registered():
    assert len(queries.queries()) == 14 and queries.oracle_sql().keys() <= queries.queries().keys()
    assert langid.UNDETERMINED == "und"
