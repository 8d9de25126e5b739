"""The numbered queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import anntree, convrepair, convtrie, fingerprint, jaccard, langid, linededup, mixing, piece_bpe, quality, secretscan, toxicity, urlfilter
from corpusmill.session import ship, table

MODEL = "piece_bpe_32k.model"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def remainder(id_col: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text")).alias("text_md5"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return anntree.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secretscan.scan_digests(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 4) != 2))
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    trees = langid.train(docs.filter(remainder("doc_id", 5) != 0))
    return langid.identify(docs, trees).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), model_file())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    turns = convtrie.numbered(table(spark, sf_dir, "conversations"))
    return convtrie.trie(convtrie.shared_heads(turns)).drop("a", "b")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.judge(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def damaged(convs: DataFrame) -> DataFrame:
    """The rows that op13 repairs: by a checksum of conversation and turn, some are gone, emptied, cut short, repeated, or the user's."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20).cast("int")
    role = F.when(F.col("lot") == 4, "user").otherwise(some("role"))
    text = F.when(F.col("lot") <= 1, "").when(F.col("lot") == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return convs.select("conv_id", "turn", "role", "text", lot.alias("lot")).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("lot") == 0).alias("gone"), copies).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return convrepair.repair(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_source_mix, op3_line_dedup, op4_nearest, op5_secret_scan, op6_fingerprint, op7_toxicity, op8_language, op9_jaccard, op10_piece_bpe, op11_prefix_trie, op12_quality_rules, op13_structure_repair, pipeline)
    return {f.__name__: f for f in own}


def _url_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    fits, names = [], []
    for r in urlfilter.BASE_RULES:
        fits.append(f"CASE WHEN (host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}) THEN {{'l': {len(r.name)}, 'n': {quoted(r.name)}, 'v': {quoted(r.verdict)}}} END")
        names.append(r.name)
    more = " ".join(f"WHEN regexp_matches(low, {quoted(r.pattern)}) THEN {{'n': {quoted(r.pattern)}, 'v': {quoted(r.verdict)}}}" for r in urlfilter.PATTERNS)
    upper, lower = quoted(urlfilter.UPPER), quoted(urlfilter.LOWER)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), {upper}, {lower}) AS host,
  regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
judged AS (SELECT page_id, host, path, translate(host || path, {upper}, {lower}) AS low,
  list_sort([x FOR x IN [{", ".join(fits)}] IF x IS NOT NULL], 'DESC')[1] AS base FROM parts),
more AS (SELECT *, CASE {more} END AS extra FROM judged)
SELECT page_id, host, path, base.n AS rule, coalesce(base.v, extra.v, 'allow') AS verdict,
  CASE WHEN base IS NULL THEN extra.n END AS pattern FROM more"""


_MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS u FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM totals),
levels AS (SELECT *, 3 * source_size AS cap,
  (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level * weight <= cap), 'inf'::DOUBLE) * weight) AS target FROM levels),
due AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM targets),
rest AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM due),
placed AS (SELECT doc_id, s.source, size, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized s)
SELECT p.doc_id, p.size, r.source_size, r.target,
  (r.epochs * p.size + greatest(0, least(p.size, r.rest - p.before)))::BIGINT AS taken
FROM placed p JOIN rest r ON p.source IS NOT DISTINCT FROM r.source"""

_LINES_SQL = f"""
WITH lines AS (SELECT source, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
each AS (SELECT source, unnest(list_distinct(l)) AS line FROM lines),
bad AS (SELECT e.source, e.line FROM each e JOIN totals t ON e.source IS NOT DISTINCT FROM t.source WHERE trim(e.line, ' ') <> ''
  GROUP BY e.source, e.line, t.host_pages HAVING count(*) >= least({linededup.LEAST_PAGES}, greatest(t.host_pages, {linededup.SMALL_HOST})) AND count(*) > {linededup.MOST_SHARE} * t.host_pages),
hosts AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (SELECT d.doc_id, d.source, d.l, [x FOR x IN d.l IF NOT list_contains(coalesce(h.bad, []), x)] AS kept FROM lines d LEFT JOIN hosts h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, coalesce(len(l) - len(kept), 0)::BIGINT AS n_dropped, length(array_to_string(kept, chr(10)))::BIGINT AS n_chars,
  md5(array_to_string(kept, chr(10))) AS text_md5 FROM cut"""

#: crc32 of a text's bytes (ASCII), by shifting bits.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(ch)::BIGINT FOR ch IN string_split({}, '')]), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"

_TRIE_SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'m': md5(length(r)::VARCHAR || ':' || r || t), 'w': len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))}} ORDER BY k) AS l FROM turns GROUP BY conv_id),
asked AS (SELECT conv_id, l, ({_CRC.format("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) AS l FROM asked a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
path AS (SELECT conv_id, len(l) AS n, [x.m FOR x IN l] AS m, [x.w FOR x IN l] AS w FROM rebuilt),
occurs AS (SELECT conv_id, n, d, list_slice(m, 1, d) AS p, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM path)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, min(w) AS w,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM occurs GROUP BY p, d),
above AS (SELECT list_slice(p, 1, a) AS p, sum((n_convs - 1) * w)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM node) GROUP BY 1),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, above.leaves AS n_leaves, above.saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN above USING (p) LEFT JOIN kids USING (p) LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = list_slice(node.p, 1, node.d - 1)"""


def oracle_sql() -> dict[str, str]:
    """The other queries are held against brute force, the library or held-out labels in tests/llm."""
    return {"op1_url_filter": _url_sql(), "op2_source_mix": _MIX_SQL, "op3_line_dedup": _LINES_SQL, "op11_prefix_trie": _TRIE_SQL}
