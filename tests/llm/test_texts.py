"""Operators 1, 5, 6 and 10 against plain Python, on the small tables and on odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fingerprint, piece_bpe, queries, secretscan, urlfilter

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "é" * 70_000, "x\x00y", "😀" * 9, "\u3000token = abcdefghijkl", "▁▁ a", "A\u0301", "tab\tnew\nline  two", "日本語テキスト", "٣٤٥"]


def rows_of(spark, texts, clash=True):
    rows = [(i * 7 - 20, t, "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def url_verdict(url):
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
        host, path = low(m[1]), m[2]
    fits = [r for r in urlfilter.BASE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict, None
    more = next((p for p in urlfilter.PATTERNS if re.search(p.pattern, low(host + path), re.ASCII)), None)
    return host, path, None, more.verdict if more else "allow", more and more.name


URLS = [None, "", "x", "http://", "http://Example.COM/en/a?b#c", "https://www.example.com/en/", "http://a.net/es/1", "a://b://c.net/fr/x", "http://net/fr/", "http://xnet/es/", "ftp://a.com", "http://c.org/ads/1", "http://ads", "http://x.net/fr", "http://e.org/es/44", "http://e.org/es/44/", "http://ü.com/é", "http://h.net\n/es/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages).collect()}
    assert got == {i: url_verdict(u) for i, u in enumerate(URLS * 2)}
    assert urlfilter.judge(pages.limit(0)).count() == 0
    for size in (1, 200):  # broadcast and shuffled rules agree
        rules = urlfilter.BASE_RULES + urlfilter.PATTERNS + tuple(urlfilter.UrlRule("block", f"h{i}.example", "/") for i in range(size))
        old, urlfilter.BROADCAST_RULES = urlfilter.BROADCAST_RULES, 100
        try:
            assert {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, rules).collect()} == got
        finally:
            urlfilter.BROADCAST_RULES = old


PARSED = (
    r"\bads\b|\btracker\b", r"(?:/foo/)?bar", r"/(ads|adx|track)/", r"\b(?:pop|push)(?:up)?\b", r"(?i)\bADS\b", r"^ads\.", r"/x[0-9]+/\bfoo\b", r"/a{2}/", r"(/foo/)+$", r"/foo/?bar/", r"(?i:track)", r"/(?:a|b){2}/", r"\b[ab]ds\b", r"ads.*|zz", r"/a+b?/",
    r"(?:^|/)go(?=/x)", r"[./-]ad[sx]?[./-]", r"\p{Alpha}zz\b", r"x(?:(?:y|z)/q)*/w\b",
)


def test_url_patterns_with_alternatives_and_optional_parts(spark):
    rnd = random.Random(9)
    bits = ["/", "/", ".", "-", "ads", "adx", "tracker", "track", "foo", "bar", "pop", "push", "up", "a", "aa", "b", "x1", "go", "zz", "w", "q", "y", "_", "é", "ADS"]
    urls = ["http://" + "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(600)]
    urls += ["http://h/ads/x", "http://h/tracker/x", "http://h/ads", "http://h/bar", "http://h/foo/bar", "http://h/popup", "http://h/push"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    parts = urlfilter.host_and_path(F.col("url"))
    low = F.translate(F.concat(*parts), urlfilter.UPPER, urlfilter.LOWER)
    for i in range(0, len(PARSED), 5):
        rules = tuple(urlfilter.UrlRule("block", pattern=p) for p in PARSED[i : i + 5])
        first = F.coalesce(*[F.when(low.rlike(r.pattern), F.lit(r.pattern)) for r in rules])
        want = {r[0]: r[1] for r in pages.select("page_id", first).collect()}
        assert {r.page_id: r.pattern for r in urlfilter.judge(pages, rules).collect()} == want and any(want.values())
    assert urlfilter.mandatory_tokens(PARSED[0]) == [["ads"], ["tracker"]] and urlfilter.mandatory_tokens(PARSED[1]) == urlfilter.mandatory_tokens("[") == []


def secrets(text):
    text = text or ""
    base = []
    for k, r in enumerate(secretscan.BASE_RULES):
        for m in r.compiled().finditer(text):
            if len(m[r.group]) >= r.least:
                base.append((m.start(), k, m.end()))
    base.sort()
    said = ",".join(f"{secretscan.BASE_RULES[k].kind}:{s}:{e}" for s, k, e in base)
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())


def secret_texts(n=300):
    rnd = random.Random(3)
    bits = ["PassWord", "api_key", "apikey", "tOken", "passwd", "secret", "'", '"', " ", "  ", ":", "=", "abcdefghijkl", "AKIA", "AKIA0123456789ABCD", "0123456789abcdef", "deadbeef", "é", "\n", "ſecret", "K", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(n)]


def test_secrets(spark):
    texts = ODD + secret_texts()
    docs = rows_of(spark, texts).union(documents(spark).select("doc_id", "text", F.lit("b")))
    want = sorted((r.doc_id, *secrets(r.text)) for r in docs.collect())
    got = secretscan.scan_digests(docs).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    listed = {(r.doc_id, f"{r.kind}:{r.start}:{r.end}") for r in secretscan.scan(docs).collect()}
    assert listed == {(r.doc_id, s) for r in got for s in r.spans.split(",") if s}
    assert any("pem:" in r.spans for r in got) and any("github:" in r.spans for r in got)
    assert secretscan.scan_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", secretscan.BASE_RULES + secretscan.MORE_RULES)
def test_trigram_queries_hold_in_every_match(rule):
    def holds(q, text):
        if q is True:
            return True
        if q[0] == "tri":
            return q[1] in text.lower().encode()
        return (all if q[0] == "and" else any)(holds(p, text) for p in q[1])

    query = secretscan.trigram_query(rule.pattern)
    for t in secret_texts() + ["gho_" + "Z9" * 20, "xoxb-0123456789-ab", "AIza" + "b" * 35, "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12]:
        if rule.compiled().search(t):
            assert holds(query, t)


def test_fingerprints(spark):
    docs = rows_of(spark, ODD + ["b\na", "a\nb", "one two three four five six seven\nlast", "one two three four five six seven"])
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs).collect()}
    assert len(got) == len(order)
    texts = [r.text or "" for r in order]
    for i, r in enumerate(order):
        edit = fingerprint.edited(texts[i], texts[(i + 1) % len(texts)])
        half = len(texts[i]) // 2
        assert edit == texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]
        own = got[r.doc_id]
        assert own.n_chars == len(texts[i]) and own.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert [own.fingerprint, own.edited_fingerprint] == fingerprint.as_text(*fingerprint.vectors([texts[i], edit]))
        assert 0 <= own.near_edited <= 1 and 0 <= own.near_next <= 1
    ab, ba = fingerprint.as_text(*fingerprint.vectors(["a\nb", "b\na"]))
    assert ab == ba and fingerprint.compare_with_edits(docs.limit(0)).count() == 0
    one = fingerprint.compare_with_edits(docs.filter("doc_id = -20")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_add_and_subtract():
    whole, part, rest = fingerprint.as_text(*fingerprint.vectors(["p one long line here\nq two\nr", "q two", "r\np one long line here"]))
    assert fingerprint.combine(rest, part) == whole and fingerprint.combine(whole, part, -1) == rest


def test_fingerprints_of_copies_and_edits(spark):
    rows = fingerprint.compare_with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars >= 200")).collect()
    assert sum(r.near_edited for r in rows) / len(rows) > sum(r.near_next for r in rows) / len(rows) + 0.2


def test_fingerprints_of_short_lines(spark):
    like = lambda a, b: float(fingerprint.likeness(*([v[i : i + 1] for v in fingerprint.vectors([a, b])] for i in (0, 1)))[0])
    items = [f"item {i}" for i in range(400)]
    text, half, other = "\n".join(items), "\n".join(items[:200] + [f"new {i}" for i in range(200)]), "\n".join(f"other {i}" for i in range(400))
    assert 0.3 < like(text, half) < 0.7 and like(text, other) < 0.3 and like(text, "\n".join(items[::-1])) == 1.0
    long = "a line that is longer than one window\n"
    assert like(long * 50 + "yes", long * 50 + "no") < 1 and like("a", "a\n") < 1 and like("", "a") == 0
    sketch = fingerprint.vectors([x for n in range(1, 16) for x in ("a" * n, "é" * (n // 2) + "b" * (n % 2))])[1]
    assert (abs(sketch.view("int32")).sum(axis=1) == 1).all()
    lines = ["x", "12345678", "123456789", "fifteen bytes..", "sixteen bytes...", "", long[:-1]]
    each = sum(fingerprint.vectors([x])[1] for x in lines)
    for texts in (["\n".join(lines)], ["y" * 20, "\n".join(lines), "z"]):
        assert (fingerprint.vectors(texts)[1][len(texts) // 2] == each).all()
    short = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and all(len(x.encode()) < 16 for x in r.text.split("\n"))]
    assert short and all(any(row) for row, r in zip(fingerprint.vectors([r.text for r in short])[1], short) if r.text.strip("\n"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_file())


def fuzz(n=1500):
    rnd = random.Random(9)
    bits = ["the", "tion", " ", "  ", "é", "\n", "\t", "😀", "日本", "ing", "▁", "<s>", "</s>", "<unk>", "<0x41>", "0", "12", "ß", "aaa", ".", "...", "\u200b", "\xa0", "x" * 30, "Ω", "\r\n", "#include"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(n)]


def test_encoding_is_the_librarys(spark, library):
    docs = rows_of(spark, ODD + fuzz()).select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    given = docs.collect()
    want = []
    for r in given:
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_bpe.encode_digests(docs, queries.model_file()).collect())) == sorted(want)
    whole = piece_bpe.encode(docs, queries.model_file()).collect()
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in whole) == sorted((r.doc_id, len(i := library.encode(r.text or "", add_eos=True)), library.decode(i)) for r in given)
    assert piece_bpe.encode(docs.limit(0), queries.model_file()).count() == 0


def test_pipeline_encodes_ids(spark, library):
    import corpus_pipeline

    texts = ODD + fuzz(200)
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, rows_of(spark, texts), SF).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, r = library.encode(t or "", add_eos=True), got[i * 7 - 20]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
