"""Spans, redaction, chunks, sections and field checks over documents, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import checks, markup, recursive, spans, text
from corpusmill.operators import clauses, references
from corpusmill.plans.registry import query
from corpusmill.session import ship, table

PERSONAL = (spans.Pattern("email", text.EMAIL, 0.95), spans.Pattern("ip", text.IP, 0.7, "address|ip"), spans.Pattern("card", text.CARD, 0.85), spans.Pattern("phone", text.PHONE, 0.8, "tel|call"))


def _sql_spans(p: spans.Pattern, x: str = "text") -> str:
    pat = "'" + p.pattern.replace("'", "''") + "'"
    m, g = f"regexp_extract_all({x}, {pat})", f"string_split_regex({x}, {pat})"
    start = "(list_sum([length(u) FOR u IN g[1:i]]) + coalesce(list_sum([length(u) FOR u IN m[1:i - 1]]), 0))::INT"
    sure = str(p.confidence) if not p.context else f"CASE WHEN regexp_matches(substr({x}, greatest(start - 20, 0) + 1, least(start, 20) + length(f) + 20), '(?i){p.context}') THEN {min(1.0, round(p.confidence + 0.2, 6))} ELSE {p.confidence} END"
    return f"SELECT doc_id, start, start + length(f) AS e, '{p.kind}' AS kind, ({sure})::DOUBLE AS confidence, f FROM (SELECT doc_id, {x}, m[i] AS f, {start} AS start FROM (SELECT doc_id, {x}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {x}, {m} AS m, {g} AS g FROM documents)))"


_SPANS = "WITH RECURSIVE s AS (" + " UNION ALL ".join(_sql_spans(p) for p in PERSONAL) + "), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, -confidence, kind) AS r FROM s), k AS (SELECT doc_id, r, e AS last, start, e, kind, confidence, f, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, CASE WHEN o.start < k.last THEN k.last ELSE o.e END, o.start, o.e, o.kind, o.confidence, o.f, o.start >= k.last FROM k JOIN o ON o.doc_id = k.doc_id AND o.r = k.r + 1)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.withColumn("kept", spans.resolve(spans.all_spans(F.col("text"), PERSONAL)))


@query(_SPANS + " SELECT doc_id, start, e::INTEGER AS stop, kind, round(confidence, 4) AS confidence, f AS found FROM k WHERE kept")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of personal data with offsets; of overlapping ones the first, and of those at one place the surest."""
    rows = _found(spark, d).select("doc_id", F.explode("kept").alias("s"))
    return rows.select("doc_id", "s.start", F.col("s.end").alias("stop"), "s.kind", F.round("s.confidence", 4).alias("confidence"), "s.found")


@query(
    _SPANS + ", q AS (SELECT doc_id, list({'s': start, 'e': e, 'f': f, 'k': kind} ORDER BY start) AS l FROM k WHERE kept GROUP BY doc_id), "
    "w AS (SELECT d.doc_id, text, coalesce(l, []) AS l FROM documents d LEFT JOIN q USING (doc_id)), "
    "t AS (SELECT doc_id, text, l, [substr(text, (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END) + 1, l[i].s - (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END)) || (CASE WHEN length(l[i].f) <= 4 THEN repeat('*', length(l[i].f)) ELSE repeat('*', length(l[i].f) - 4) || l[i].f[-4:] END) FOR i IN range(1, len(l) + 1)] AS masked, "
    "[substr(text, (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END) + 1, l[i].s - (CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END)) || (CASE l[i].k WHEN 'email' THEN '[E-POSTA]' WHEN 'ip' THEN '[IP-ADRESI]' WHEN 'card' THEN '[KART-NO]' ELSE '[TELEFON]' END) FOR i IN range(1, len(l) + 1)] AS put FROM w) "
    "SELECT doc_id, len(l)::BIGINT AS entities, md5(array_to_string(masked, '') || substr(text, (CASE WHEN len(l) = 0 THEN 0 ELSE l[-1].e END) + 1)) AS masked_md5, md5(array_to_string(put, '') || substr(text, (CASE WHEN len(l) = 0 THEN 0 ELSE l[-1].e END) + 1)) AS replaced_md5 FROM t"
)
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with spans masked but for four characters, and with placeholders put in."""
    x, kept = F.col("text"), F.col("kept")
    return _found(spark, d).select("doc_id", F.size(kept).cast("long").alias("entities"), F.md5(spans.redact(x, kept, "mask")).alias("masked_md5"), F.md5(spans.redact(x, kept, "replace")).alias("replaced_md5"))


_MARKED = "replace(text, chr(10), chr(10) || 'MADDE 7 ')"


@query(
    f"WITH t AS (SELECT doc_id, regexp_extract_all(x, '(MADDE|Madde) +[0-9]+') AS m, string_split_regex(x, '(MADDE|Madde) +[0-9]+') AS g FROM (SELECT doc_id, {_MARKED} AS x FROM documents)), p AS (SELECT doc_id, list_concat([('preamble', trim(g[1], ' ' || chr(10) || chr(9) || chr(13)))], [('part', trim(m[i] || g[i + 1], ' ' || chr(10) || chr(9) || chr(13))) FOR i IN range(1, len(m) + 1)]) AS l FROM t), "
    "u AS (SELECT doc_id, unnest([x FOR x IN l IF NOT (x[1] = 'preamble' AND x[2] = '')]) AS x, unnest(range(0, len([x FOR x IN l IF NOT (x[1] = 'preamble' AND x[2] = '')]))) AS i FROM p) SELECT doc_id || '_' || i AS chunk_id, x[1] AS kind, md5(x[2]) AS part_md5 FROM u"
)
def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each article (lines stand for articles here), with what lies before the first, and ids that number them."""
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit("\nMADDE 7 "))
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(spans.marked_parts(marked, "(MADDE|Madde) +[0-9]+")).alias("i", "x"))
    return rows.select(F.concat_ws("_", "doc_id", "i").alias("chunk_id"), "x.kind", F.md5("x.part").alias("part_md5"))


@query(
    "WITH s AS (SELECT doc_id, string_split_regex(text, '[.!?][ \\t\\n\\r\\f]+') AS l FROM documents), r AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.size + length(x) > 512 AND a.n > 0 THEN {'done': list_append(a.done, a.now), 'now': x, 'size': length(x), 'n': 1::BIGINT} WHEN a.n = 0 THEN {'done': a.done, 'now': x, 'size': length(x), 'n': 1::BIGINT} ELSE {'done': a.done, 'now': a.now || ' ' || x, 'size': a.size + length(x), 'n': a.n + 1} END, {'done': []::VARCHAR[], 'now': '', 'size': 0::BIGINT, 'n': 0::BIGINT}) AS a FROM s) "
    "SELECT doc_id, (i - 1)::INTEGER AS chunk, md5(c[i]) AS chunk_md5 FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, list_append(a.done, a.now) AS c FROM r WHERE a.n > 0))"
)
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed into chunks of at most 512 characters."""
    ship(spark)
    sentences = F.split("text", r"[.!?][ \t\n\r\f]+", -1)
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(spans.packed(sentences, 512)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.md5("c").alias("chunk_md5"))


_SKIP = ("sayfa", "page", "www.", "http://", "https://")


@query(
    "WITH l AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(text, chr(10))] AS l FROM documents), c AS (SELECT doc_id, l, array_to_string([x FOR x IN l IF length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND NOT regexp_matches(lower(x), 'sayfa|page|www[.]|http://|https://')], chr(10)) AS cleaned FROM l) "
    "SELECT doc_id, md5(cleaned) AS cleaned_md5, len([x FOR x IN string_split(cleaned, chr(10)) IF length(x) >= 20])::BIGINT AS paragraphs, len([x FOR x IN l IF upper(x) = x AND lower(x) <> x AND length(x) > 3 OR regexp_matches(upper(x), '^(MADDE|BÖLÜM|KISIM|EK|GEÇİCİ)')])::BIGINT AS headings FROM c"
)
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines without page numbers, addresses and scraps; paragraphs of twenty characters; headings."""
    cleaned = checks.clean_lines(F.col("text"), _SKIP)
    heads = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[\t\r ]+|[\t\r ]+$", "")), checks.is_heading)
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", cleaned.alias("c"), F.size(heads).cast("long").alias("headings"))
    return rows.select("doc_id", F.md5("c").alias("cleaned_md5"), F.size(F.filter(F.split("c", "\n"), lambda x: F.length(x) >= 20)).cast("long").alias("paragraphs"), "headings")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l), "
    "h AS (SELECT doc_id, line, start FROM p WHERE regexp_matches(line, '^[^a-zà-ÿ]{4,}$') AND regexp_matches(line, '[A-Z]')) SELECT doc_id, md5(line) AS title_md5, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), (SELECT length(text) FROM documents d WHERE d.doc_id = h.doc_id))::BIGINT AS stop FROM h"
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines (no small letters), from each up to the next or the end of the text, by character."""
    return text.sections_by(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", F.col("line").rlike("^[^a-zà-ÿ]{4,}$") & F.col("line").rlike("[A-Z]")).select("doc_id", F.md5("line").alias("title_md5"), "start", "stop")


_LAW = "'Madde ' || (o_orderkey % 60) || ' uyarınca ' || (1000 + o_custkey) || ' sayılı Kanun, E. No: ' || year(o_orderdate) || '/' || (o_orderkey % 900) || ', K. No: ' || year(o_orderdate) || '/' || (o_custkey % 700) || ', RG No: ' || (20000 + o_orderkey % 9000)"


@query(
    f"WITH t AS (SELECT o_orderkey, {_LAW} AS x FROM orders) SELECT o_orderkey, regexp_extract_all(x, '[0-9]{{3,5}} +sayılı')[1] AS law, regexp_extract(x, 'Madde +([0-9]+)', 1) AS article, regexp_extract(x, 'E[.] *No: *([0-9]{{4}}/[0-9]+)', 1) || ' ' || regexp_extract(x, 'K[.] *No: *([0-9]{{4}}/[0-9]+)', 1) AS case_no, regexp_extract(x, 'RG No: *([0-9]+)', 1) AS gazette, regexp_matches(x, '[0-9]{{3,5}} +sayılı') AS is_law, regexp_matches(x, 'Yargıtay|Danıştay') AS is_court FROM t"
)
def legal_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Law, article, case and gazette numbers in a text made of each order's fields."""
    y = F.year("o_orderdate")
    x = F.concat(F.lit("Madde "), F.pmod("o_orderkey", F.lit(60)), F.lit(" uyarınca "), 1000 + F.col("o_custkey"), F.lit(" sayılı Kanun, E. No: "), y, F.lit("/"), F.pmod("o_orderkey", F.lit(900)), F.lit(", K. No: "), y, F.lit("/"), F.pmod("o_custkey", F.lit(700)), F.lit(", RG No: "), 20000 + F.pmod("o_orderkey", F.lit(9000)))
    return table(spark, d, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", *[c.alias(n) for n, c in text.legal_numbers(F.col("x")).items()])


@query(
    "WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+90 ' WHEN 1 THEN '0' WHEN 2 THEN '90' ELSE '' END || (5000000000 + c_custkey * 7919 % 999999999) AS phone, 'user' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '@mail' END || '.com' AS mail, CASE WHEN c_custkey % 3 = 0 THEN 'ftp' ELSE 'https' END || '://a.b/' || c_custkey AS url, 'Report v' || c_custkey || '?. final.PDF' AS file FROM customer), "
    "q AS (SELECT *, CASE WHEN starts_with(regexp_replace(phone, '[ ()-]', '', 'g'), '+90') THEN substr(regexp_replace(phone, '[ ()-]', '', 'g'), 4) WHEN starts_with(phone, '90') THEN substr(phone, 3) WHEN starts_with(phone, '0') THEN substr(phone, 2) ELSE phone END AS bare FROM p) "
    "SELECT c_custkey, regexp_full_match(bare, '5[0-9]{9}') AS phone_ok, CASE WHEN regexp_full_match(bare, '5[0-9]{9}') THEN '+90 ' || substr(bare, 1, 3) || ' ' || substr(bare, 4, 3) || ' ' || substr(bare, 7, 2) || ' ' || substr(bare, 9, 2) ELSE bare END AS phone, regexp_full_match(mail, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}') AS mail_ok, regexp_matches(url, '^https?://[^ /$.?#].[^ ]*$') AS url_ok, 'pdf' AS extension, 'Report_v' || c_custkey || '._final.PDF' AS filename, c_custkey % 3 * CASE c_custkey % 2 WHEN 0 THEN 30 ELSE 365 END AS delay FROM q"
)
def field_checks(spark: SparkSession, d: str) -> DataFrame:
    """Phones, addresses, file names and delays made from customer numbers, checked and tidied."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    c = table(spark, d, "customer").select(
        k,
        F.concat(pick(4, "+90 ", "0", "90", ""), 5000000000 + F.pmod(k * 7919, F.lit(999999999))).alias("phone"),
        F.concat(F.lit("user"), k, F.when(F.pmod(k, F.lit(5)) == 0, "").otherwise("@mail"), F.lit(".com")).alias("mail"),
        F.concat(pick(3, "ftp", "https", "https"), F.lit("://a.b/"), k).alias("url"),
        F.concat(F.lit("Report v"), k, F.lit("?. final.PDF")).alias("file"),
        F.concat(F.pmod(k, F.lit(3)), F.lit(" "), pick(2, "ay", "yıl"), F.lit(" sonra")).alias("said"),
    )
    return c.select("c_custkey", checks.valid_phone(F.col("phone")).alias("phone_ok"), checks.format_phone(F.col("phone")).alias("phone"), checks.valid_email(F.col("mail")).alias("mail_ok"), checks.valid_url(F.col("url")).alias("url_ok"), checks.file_extension(F.col("file")).alias("extension"), checks.safe_filename(F.col("file")).alias("filename"), checks.delay_days(F.col("said")).cast("long").alias("delay"))


@query("SELECT doc_id, md5(trim(CASE WHEN length(one) > 0.7 * length(text) THEN array_to_string([w FOR w IN string_split(one, ' ') IF lower(w) NOT IN ('the', 'of', 'and', 'de', 'la')], ' ') ELSE one END, ' ')) AS compressed_md5, md5(CASE WHEN length(text) // 4 <= 100 THEN text ELSE substr(text, 1, 400) || '...' END) AS limited_md5, md5(CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 57) || '...' END) AS cut_md5 FROM (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS one FROM documents)")
def compressed_prompts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(checks.compressed(x, ("the", "of", "and", "de", "la"))).alias("compressed_md5"), F.md5(checks.within_tokens(x, 100)).alias("limited_md5"), F.md5(checks.cut_off(x, 60)).alias("cut_md5"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>', 1))::INTEGER AS level, trim(regexp_replace(unnest(regexp_extract_all(html, '<h[1-6][^>]*>(.*?)</h[1-6]>', 1)), '<[^>]*>', '', 'g')) AS heading FROM pages")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    each = F.arrays_zip(F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)).alias("heading"))
    return table(spark, d, "pages").select("page_id", F.inline(each)).select("page_id", F.col("level").cast("int").alias("level"), F.trim(F.regexp_replace("heading", "<[^>]*>", "")).alias("heading"))


@query("SELECT page_id, href, replace(replace(replace(trim(regexp_replace(inner_, '<[^>]*>', '', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS anchor FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=[\"'']([^\"'']*)[\"''][^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href=[\"''][^\"'']*[\"''][^>]*>(.*?)</a>', 1)) AS inner_ FROM pages)")
def html_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Links with the text between their tags, entities put back."""
    a = r"""<a [^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    each = F.arrays_zip(F.regexp_extract_all("html", F.lit(a), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(a), F.lit(2)).alias("inner_"))
    return table(spark, d, "pages").select("page_id", F.inline(each)).select("page_id", "href", text.entities(F.trim(F.regexp_replace("inner_", "<[^>]*>", ""))).alias("anchor"))


@query("SELECT source, lang, n, round(score, 6) AS score FROM (SELECT source, lang, count(*) AS n, avg(0.3 * (CASE WHEN length(text) >= 200 THEN 1 ELSE length(text) / 200 END) + 0.35 * least(len(regexp_extract_all(text, '[.!?]')) / 5, 1) + 0.15 * ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT) / 2 + 0.2 * (NOT regexp_matches(text, 'Ã.|Ä.|Å.|�'))::INT) AS score FROM documents WHERE text IS NOT NULL GROUP BY ALL)")
def confidence_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Structure .3, content .35, metadata .15, consistency .2: mean of documents."""
    x = F.col("text")
    there = lambda c: F.col(c).isNotNull().cast("int")
    score = 0.3 * F.least(F.length(x) / 200, F.lit(1.0)) + 0.35 * F.least(F.regexp_count(x, F.lit("[.!?]")) / 5, F.lit(1.0)) + 0.15 * (there("lang") + there("source")) / 2 + 0.2 * (~x.rlike(text.MOJIBAKE)).cast("int")
    return table(spark, d, "documents").filter("text is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score"))


@query("SELECT doc_id, list_filter([CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'missing text' END, CASE WHEN lang IS NULL THEN 'missing lang' END, CASE WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown lang' END, CASE WHEN n_chars <> length(text) THEN 'wrong length' END, CASE WHEN length(text) < 20 THEN 'too short' END, CASE WHEN length(text) > 50000 THEN 'too long' END, CASE WHEN regexp_matches(text, '[!?#*&$%]{3,}') THEN 'repeated marks' END, CASE WHEN NOT regexp_matches(text, '[.]') THEN 'no sentence' END], lambda x: x IS NOT NULL).list_aggregate('string_agg', '; ') AS issues FROM documents")
def document_issues(spark: SparkSession, d: str) -> DataFrame:
    """Required fields, allowed values, lengths, bad and absent patterns: what fails, in order."""
    from corpusmill.functions import dates

    x = F.col("text")
    issues = dates.issues(
        {
            "missing text": x.isNull() | (F.trim(x) == ""), "missing lang": F.col("lang").isNull(), "unknown lang": ~F.col("lang").isin("en", "de", "fr", "es"), "wrong length": F.col("n_chars") != F.length(x),
            "too short": F.length(x) < 20, "too long": F.length(x) > 50000, "repeated marks": x.rlike("[!?#*&$%]{3,}"), "no sentence": ~F.contains(x, F.lit(".")),
        }
    )
    return table(spark, d, "documents").select("doc_id", F.when(F.size(issues) > 0, F.array_join(issues, "; ")).alias("issues"))


_TYPES = {"greeting": ("the", "of"), "german": ("der", "und"), "french": ("le", "les")}


@query(
    "WITH c AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(substr(text, 1, 5000)), '{'|'.join(w)}')) AS {k}" for k, w in _TYPES.items()) + " FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CASE WHEN greatest(greeting, german, french) = 0 THEN 'none' WHEN greeting >= german AND greeting >= french THEN 'greeting' WHEN german >= french THEN 'german' ELSE 'french' END AS kind, round(least(greatest(greeting, german, french) / 10 * CASE WHEN greatest(greeting, german, french) >= 3 THEN 1.2 ELSE 1 END, 1), 6) AS confidence, round(CASE WHEN greeting + german + french > 0 THEN greeting / (greeting + german + french) ELSE 0 END, 6) AS greeting_share FROM c"
)
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each type's words in the first 5000 characters (the feature's own limit); the first of the largest wins, three hits add a fifth."""
    head = F.lower(F.substring("text", 1, 5000))
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", *[F.regexp_count(head, F.lit("|".join(w))).alias(k) for k, w in _TYPES.items()])
    top, total = F.greatest(*_TYPES), F.col("greeting") + F.col("german") + F.col("french")
    kind = F.when(top == 0, "none").when(F.col("greeting") == top, "greeting").when(F.col("german") == top, "german").otherwise("french")
    sure = F.least(top / 10 * F.when(top >= 3, 1.2).otherwise(1.0), F.lit(1.0))
    return rows.select("doc_id", kind.alias("kind"), F.round(sure, 6).alias("confidence"), F.round(F.coalesce(F.try_divide("greeting", total), F.lit(0.0)), 6).alias("greeting_share"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at ever finer separators until parts fit, small neighbours joined. The tests hold it against a plain recursion."""
    ship(spark)
    c = recursive.chunks(table(spark, d, "documents"))
    return c.select("doc_id", "chunk", "start", "stop", "depth", F.md5("part").alias("part_md5"), F.md5("after").alias("after_md5"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: of nine lines one begins a paragraph, three a clause, and two a subclause."""
    mark = lambda i: F.element_at(F.array(*[F.lit(m) for m in ("", "({0}) ", "a) ", "", "b) ", "   i) ", "c) ", "\tii) ", "")]), F.pmod(i, F.lit(9)).cast("int") + 1)
    line = lambda v, i: F.concat(F.replace(mark(i), F.lit("{0}"), i.cast("string")), v)
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.col("doc_id").alias("number"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("content"))


@query()
def clause_trees(spark: SparkSession, d: str) -> DataFrame:
    """Articles as trees of paragraphs, clauses and subclauses, with paths. The tests hold it against a plain parser."""
    t = clauses.clause_tree(_articles(spark, d))
    return t.select("doc_id", "kind", "number", "level", "path", "parent_path", F.md5("lead").alias("lead_md5"), F.md5("content").alias("content_md5"))


@query()
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    """Pages as trees of elements. The tests hold it against the standard library's parser."""
    ship(spark)
    e = markup.elements(table(spark, d, "pages"))
    return e.select("page_id", "node", "parent", "depth", "tag", F.map_keys("attributes").alias("names"), F.md5("text").alias("text_md5"))


@query()
def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables at their places; the pages' lists stand for tables, a row for each item with a cell that spans two rows."""
    ship(spark)
    page = F.col("html")
    for old, new in (("<ul>", "<table><tr><th rowspan=2>list"), ("<li>", "<tr><td>"), ("</li>", "<td>&amp;"), ("</ul>", "</table>")):
        page = F.replace(page, F.lit(old), F.lit(new))
    return markup.table_cells(table(spark, d, "pages").select("page_id", page.alias("html")))


@query()
def html_structured_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of pages by structure: headings, items, quotes and rows marked, scripts and styles left out."""
    ship(spark)
    return markup.structured_text(table(spark, d, "pages")).select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Documents with mentions of articles and laws put before their lines."""
    mark = lambda i: F.element_at(F.array(*[F.lit(m) for m in ("Madde {0} ", "", "anılan madde ", "1{0} sayılı Medeni Kanunu ", "aşağıdaki son madde ", "söz konusu kanun ", "bu fıkra ", "işbu madde ")]), F.pmod(i * 3 + F.col("doc_id"), F.lit(8)).cast("int") + 1)
    line = lambda v, i: F.concat(F.replace(mark(i), F.lit("{0}"), F.lpad((i % 999).cast("string"), 3, "0")), v)
    return table(spark, d, "documents").filter("text is not null and doc_id is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query()
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References with the article or law that they point at. The tests hold it against a plain scan."""
    ship(spark)
    return references.references(_cited(spark, d))
