"""Logic of legal texts: articles that oblige and forbid the same, exclude each other, hold conditions that lead nowhere, set unlike terms, exempt what is out of scope, or refer to each other in circles.

Articles are rows (doc_id, place, number, content). What one says is told by Column
functions; articles of a document meet by totals of (document) and (document, subject),
so an article gets the number of those that it collides with and one of them, and no
pairs are made. Obligations and bans are signed facts that pass from an article to those
that name it as their condition, level by level, until nothing is new.

Words are looked for as parts of the text in lower case, and the subject is the first
word. Defined results: rows without a document are left out; a null content is empty and
says nothing; an article without a number takes part, but none can refer to it; two
articles at one place count as two; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.session import durable

# Words of conditions, consequences, obligations, bans, exemptions, negations and priority.
CONDITION = ("eğer", "ise", "olması halinde", "durumunda", "şartıyla", "koşuluyla", "kaydıyla", "halinde", "takdirde", "olduğunda")
CONSEQUENCE = ("uygulanır", "geçerlidir", "olur", "kabul edilir", "sayılır", "yapılır", "zorunludur", "mecburidir", "gereklidir", "lazımdır")
OBLIGATION = ("zorunludur", "mecburidir", "gereklidir", "yükümlüdür", "yapılır", "yapmak zorundadır", "etmek zorundadır", "sağlamak zorundadır", "uymak zorundadır")
PROHIBITION = ("yasaktır", "yasaklanmıştır", "edilemez", "yapılamaz", "olunamaz", "kullanılamaz", "mümkün değildir", "caiz değildir", "olmaz", "kabul edilemez")
EXEMPTION = ("hariç", "istisna", "muaf", "dışında", "uygulanmaz", "bu hükümler kapsamında değildir", "bu madde kapsamı dışındadır")
NEGATION = ("değil", "olmayan", "olmadığı", "hariç", "dışında", "yoksa", "bulunmayan", "içermeyen")
PRIORITY = ("öncelikle", "ilk olarak", "özel hüküm", "istisnası")
ONLY = ("sadece", "yalnızca")
SCOPE = ("kapsam", "scope")
#: Ranks of norms, the highest first.
HIERARCHY = ("anayasa", "kanun", "kanun hükmünde kararname", "cumhurbaşkanlığı kararnamesi", "tüzük", "yönetmelik", "tebliğ", "genelge")
NEEDS_AUTHORITY = ("yönetmelik", "tebliğ", "genelge")
DAYS = {"gün": 1, "ay": 30, "yıl": 365}

REFERENCE = r"([0-9]+)\.\s*madde"
TERM = rf"([0-9]{{1,5}})\s+({'|'.join(DAYS)})\s+içinde"
DATED = r"([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\S*\s+(?:tarihinden\s+)?(önce|sonra)"
EXEMPTED = r"(\S+)\s+(?:hariç|istisna|muaf|dışında)"

FINDING = "doc_id", "place", "number", "finding", "about", "other", "n_others"


def _has(x: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(x, F.lit(w))
    return out


def _all(x: Column, pattern: str, group: int, words: tuple[str, ...]) -> Column:
    """Every match of a pattern; a text without one of these words, which each match holds, isn't searched."""
    return F.when(_has(x, words), F.regexp_extract_all(x, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def provisions(articles: DataFrame) -> DataFrame:
    """doc_id, place, number, subject, obliges, forbids, conditional, concludes, impossible, spared (words exempted; null where there is no exemption), scope (the content in lower case, where it speaks of the scope), only (which of ONLY it has), prior, term (days), refers (numbers of articles) and dated (date and side)."""
    low = F.lower(F.coalesce("content", F.lit("")))
    rows = articles.filter("doc_id is not null").select("doc_id", "place", F.col("number").cast("string").alias("number"), low.alias("low"))
    x = F.col("low")
    days = F.create_map(*[F.lit(v) for pair in DAYS.items() for v in pair])
    term = F.when(_has(x, ("içinde",)), F.regexp_extract(x, TERM, 1).try_cast("int") * F.try_element_at(days, F.regexp_extract(x, TERM, 2)))
    sides = ("önce", "sonra")
    dated = F.arrays_zip(_all(x, DATED, 1, sides).alias("date"), _all(x, DATED, 2, sides).alias("side"))
    first = F.regexp_extract(x, r"[^\t-\r ]+", 0)
    return rows.select(
        "doc_id", "place", "number", F.when(first != "", first).alias("subject"), _has(x, OBLIGATION).alias("obliges"), _has(x, PROHIBITION).alias("forbids"), _has(x, CONDITION).alias("conditional"), _has(x, CONSEQUENCE).alias("concludes"),
        (F.contains(x, F.lit("hem de")) & _has(x, NEGATION)).alias("impossible"), F.when(_has(x, EXEMPTION), F.array_distinct(F.regexp_extract_all(x, F.lit(EXEMPTED), F.lit(1)))).alias("spared"), F.when(_has(x, SCOPE), x).alias("scope"),
        F.filter(F.array(*[F.lit(w) for w in ONLY]), lambda w: F.contains(x, w)).alias("only"), _has(x, PRIORITY).alias("prior"), term.alias("term"), F.array_distinct(_all(x, REFERENCE, 1, ("madde",))).alias("refers"), F.array_distinct(dated).alias("dated"),
    )


def _at(*first: str) -> Column:
    """An article by its place (or by what is named before it), as aggregates order it."""
    return F.struct(*first, "place", "number")


def _exclusive(rows: DataFrame, takes_part: Column, name: str) -> DataFrame:
    """Each article that takes part gets the number of others of its document that do and share a word of ONLY: those with either of its words, less those with both."""
    part = rows.filter(takes_part & (F.size("only") > 0)).select("doc_id", "place", "number", "only")
    has = {w: F.array_contains("only", w) for w in ONLY}
    counts = [F.count_if(c).alias(f"n_{i}") for i, c in enumerate(has.values())] + [F.count_if(has[ONLY[0]] & has[ONLY[1]]).alias("n_both")]
    ends = [f(F.when(c, _at())).alias(f"{n}_{i}") for i, c in enumerate(has.values()) for n, f in (("first", F.min), ("last", F.max))]
    met = part.join(part.groupBy("doc_id").agg(*counts, *ends), "doc_id")
    own = [F.array_contains("only", w) for w in ONLY]
    n = F.when(own[0], F.col("n_0")).otherwise(0) + F.when(own[1], F.col("n_1")).otherwise(0) - F.when(own[0] & own[1], F.col("n_both")).otherwise(0) - 1
    one = lambda end, pick: pick(F.when(own[0], F.col(f"{end}_0")), F.when(own[1], F.col(f"{end}_1")))
    head, tail = one("first", F.least), one("last", F.greatest)
    other = F.when(head.eqNullSafe(_at()), tail).otherwise(head)
    return met.select("doc_id", "place", "number", F.lit(name).alias("finding"), F.array_join("only", ",").alias("about"), other["number"].alias("other"), n.alias("n_others")).filter("n_others > 0")


def findings(articles: DataFrame) -> DataFrame:
    """doc_id, place, number, finding, about, other (number of an article that it collides with), n_others (how many it collides with).

    contradiction: an obligation whose subject an article of the document forbids something (itself counts); other is the first.
    exclusive_obligations: obligations that share "only"; exclusive: any articles that do and say nothing of priority; other is the first such, or the last where that is the article itself.
    incomplete_condition, impossible_condition: a condition without a consequence; with "both … and" beside a negation.
    conflicting_terms: obligations on one subject with unlike terms; other is the first of the shortest term, or for those of it the last of the longest.
    exceeding_exemption: words exempted that the document's first article on its scope doesn't have; n_others counts them, about joins them.
    before_and_after: one subject bound before and after one date; other is the first on the other side.
    """
    # texts are gone through once: what they say is small, and every check below reads it
    flags = durable(provisions(articles))
    ruled = F.col("obliges") | F.col("forbids")
    by_subject = flags.filter(ruled & F.col("subject").isNotNull()).groupBy("doc_id", "subject").agg(
        F.count_if("forbids").alias("n_forbid"), F.min(F.when(F.col("forbids"), _at())).alias("forbidder"),
        F.count_if(F.col("obliges") & F.col("term").isNotNull()).alias("n_terms"), F.min(F.when(F.col("obliges") & F.col("term").isNotNull(), _at("term"))).alias("shortest"), F.max(F.when(F.col("obliges") & F.col("term").isNotNull(), _at("term"))).alias("longest"),
    )
    obliging = flags.filter(F.col("obliges") & F.col("subject").isNotNull())
    met = obliging.join(by_subject, ["doc_id", "subject"])
    contradiction = met.filter("n_forbid > 0").select("doc_id", "place", "number", F.lit("contradiction").alias("finding"), F.col("subject").alias("about"), F.col("forbidder.number").alias("other"), F.col("n_forbid").alias("n_others"))

    alike = obliging.filter("term is not null").groupBy("doc_id", "subject", "term").agg(F.count("*").alias("n_same"))
    unlike = met.filter("shortest.term < longest.term and term is not null").join(alike, ["doc_id", "subject", "term"])
    far = F.when(F.col("term") == F.col("shortest.term"), F.col("longest.number")).otherwise(F.col("shortest.number"))
    terms = unlike.select("doc_id", "place", "number", F.lit("conflicting_terms").alias("finding"), F.col("subject").alias("about"), far.alias("other"), (F.col("n_terms") - F.col("n_same")).alias("n_others"))

    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    lone = F.filter(F.array(F.when(F.col("conditional") & ~F.col("concludes"), "incomplete_condition"), F.when(F.col("conditional") & F.col("impossible"), "impossible_condition")), lambda c: c.isNotNull())
    conditions = flags.select("doc_id", "place", "number", F.explode(lone).alias("finding")).select("*", none.alias("about"), none.alias("other"), zero.alias("n_others"))

    scopes = flags.filter("scope is not null").groupBy("doc_id").agg(F.min_by(F.struct(F.col("scope").alias("low"), "number"), _at()).alias("scope"))
    spared = flags.filter(F.size("spared") > 0).select("doc_id", "place", "number", "spared")
    beyond = spared.join(scopes, "doc_id").select("doc_id", "place", "number", F.filter("spared", lambda w: ~F.contains(F.col("scope.low"), w)).alias("beyond"), F.col("scope.number").alias("other")).filter(F.size("beyond") > 0)
    exempt = beyond.select("doc_id", "place", "number", F.lit("exceeding_exemption").alias("finding"), F.array_join("beyond", ",").alias("about"), "other", F.size("beyond").cast("long").alias("n_others"))

    said = flags.filter(F.col("subject").isNotNull()).select("doc_id", "place", "number", "subject", F.inline("dated"))
    early, late = F.col("side") == "önce", F.col("side") == "sonra"
    dated = said.groupBy("doc_id", "subject", "date").agg(F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"), F.min(F.when(early, _at())).alias("early"), F.min(F.when(late, _at())).alias("late")).filter("n_early > 0 and n_late > 0")
    both = said.join(dated, ["doc_id", "subject", "date"]).select("doc_id", "place", "number", F.lit("before_and_after").alias("finding"), F.concat_ws(" ", "subject", "date").alias("about"), F.when(early, F.col("late.number")).otherwise(F.col("early.number")).alias("other"), F.when(early, F.col("n_late")).otherwise(F.col("n_early")).alias("n_others"))

    every = [contradiction, terms, conditions, exempt, both, _exclusive(flags, F.col("obliges"), "exclusive_obligations"), _exclusive(flags, ~F.col("prior"), "exclusive")]
    out = every[0].select(*FINDING)
    for more in every[1:]:
        out = out.unionByName(more.select(*FINDING))
    return out


def reference_edges(articles: DataFrame, conditional_only: bool = False) -> DataFrame:
    """src, dst (structs of document and number): which article names which."""
    rows = provisions(articles).filter("number is not null")
    return _edges(rows.filter("conditional") if conditional_only else rows)


def _edges(rows: DataFrame) -> DataFrame:
    node = lambda n: F.struct("doc_id", F.col(n).alias("number"))
    return rows.select("doc_id", "number", F.explode("refers").alias("named")).select(node("number").alias("src"), node("named").alias("dst")).distinct()


def circular_references(articles: DataFrame) -> DataFrame:
    """doc_id, number, length: articles that lead back to themselves by what they name, with the fewest steps that do."""
    return graph.cyclic(reference_edges(articles)).select("node.doc_id", "node.number", "length")


def inherited_contradictions(articles: DataFrame) -> DataFrame:
    """doc_id, number, subject, obliged_at, forbidden_at: articles that are bound both ways on a subject once they take over what the articles say that they name in a condition, at how many steps each way (0: said by the article itself).

    Only subjects that a document both obliges and forbids are followed. Each round
    carries what was new in the last one, so there are as many as the longest way.
    """
    bound = "subject is not null and (obliges or forbids)"
    naming = "conditional and size(refers) > 0"
    # texts are gone through once, for facts and references
    told = durable(provisions(articles).filter(f"number is not null and ({bound} or {naming})").select("doc_id", "number", "subject", "obliges", "forbids", "conditional", "refers"))
    rows = told.filter(bound)
    signs = F.filter(F.array(F.when(F.col("obliges"), 1), F.when(F.col("forbids"), -1)), lambda s: s.isNotNull())
    own = rows.select("doc_id", "number", "subject", F.explode(signs).alias("sign")).distinct()
    torn = own.groupBy("doc_id", "subject").agg(F.min("sign").alias("a"), F.max("sign").alias("b")).filter("a < b").select("doc_id", "subject")
    key = ["doc_id", "number", "subject", "sign"]
    known = front = durable(own.join(torn, ["doc_id", "subject"], "left_semi").select(*key).withColumn("level", F.lit(0)))
    edges = durable(_edges(told.filter(naming)).join(known.select("doc_id").distinct(), F.col("src.doc_id") == F.col("doc_id"), "left_semi").select("src.doc_id", F.col("src.number").alias("taker"), F.col("dst.number").alias("number")))
    level = 0
    while not front.isEmpty():
        level += 1
        step = front.join(edges, ["doc_id", "number"]).select("doc_id", F.col("taker").alias("number"), "subject", "sign").distinct()
        front = durable(step.join(known, key, "left_anti").withColumn("level", F.lit(level)))
        known = known.unionByName(front)
    at = lambda sign: F.min(F.when(F.col("sign") == sign, F.col("level")))
    return known.groupBy("doc_id", "number", "subject").agg(at(1).alias("obliged_at"), at(-1).alias("forbidden_at")).filter("obliged_at is not null and forbidden_at is not null and obliged_at + forbidden_at > 0")


def lacks_authority(kind: Column, authority: Column) -> Column:
    """Norms that need a law's authority and name none; false where the kind is null."""
    return F.coalesce(F.lower(kind).isin(*NEEDS_AUTHORITY) & (F.trim(F.coalesce(authority, F.lit(""))) == ""), F.lit(False))


def rank_of(kind: Column) -> Column:
    """1 for the highest norm; null for others."""
    at = F.array_position(F.array(*[F.lit(k) for k in HIERARCHY]), F.lower(kind))
    return F.when(at > 0, at.cast("int"))
