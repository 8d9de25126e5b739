"""Column functions that score documents for queries: words are arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the rerankers, boosts by document type.
STOP_WORDS = ("ve", "veya", "ile", "için", "bu", "şu", "o", "bir", "de", "da")
TYPE_BOOSTS = {"KANUN": 0.3, "YONETMELIK": 0.2, "YARGITAY_KARARI": 0.25, "ANAYASA_MAHKEMESI": 0.3}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(x: Column) -> Column:
    """Stretches without white space, in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[^\t-\r ]+"), F.lit(0))


def without_stop_words(w: Column) -> Column:
    return F.array_except(w, _strings(STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has; 0 without any."""
    a, b = without_stop_words(a), without_stop_words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def heuristic(query: Column, document: Column) -> Column:
    """Share of words met, 0.3 more where the whole query occurs, at most 1."""
    share = overlap(words(query), words(document))
    none = F.size(without_stop_words(words(query))) == 0
    return F.when(none, 0.0).otherwise(F.least(share + F.when(F.contains(F.lower(document), F.lower(query)), 0.3).otherwise(0.0), F.lit(1.0)))


def keyword(query: Column, terms: Column, document: Column) -> Column:
    """0.5 coverage, 0.3 frequency, 0.04 where the query's words occur as they are; query and terms are word arrays."""
    asked = F.array_distinct(query)
    met = F.size(F.array_intersect(asked, terms))
    often = F.least(F.size(F.filter(terms, lambda t: F.array_contains(asked, t))) / (F.size(terms) + 1), F.lit(1.0))
    phrase = F.when(F.contains(F.lower(document), F.array_join(query, " ")), 0.2).otherwise(0.0)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.least(met / F.size(asked) * 0.5 + often * 0.3 + phrase * 0.2, F.lit(1.0)))


def phrases(query: Column, document: Column) -> Column:
    """Runs of 4, 3 and 2 of the query's words that occur in the document, longest first, each once."""
    runs = lambda n: F.when(F.size(query) >= n, F.transform(F.sequence(F.lit(1), F.size(query) - n + 1), lambda i: F.array_join(F.slice(query, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(runs(4), runs(3), runs(2)), lambda p: F.contains(F.lower(document), p)))


def age_band(year: Column, now: int) -> Column:
    """1, .95, .85, .7, .5 and .3 for ages up to 0, 2, 5, 10, 20 and more years; .5 without a year."""
    age = F.lit(now) - year
    return F.when(year.isNull(), 0.5).when(age <= 0, 1.0).when(age <= 2, 0.95).when(age <= 5, 0.85).when(age <= 10, 0.7).when(age <= 20, 0.5).otherwise(0.3)


def authority_band(court: Column, source: Column) -> Column:
    """By what names of court and source contain (lower case)."""
    c = F.coalesce(court, F.lit(""))
    has = lambda x, *names: F.exists(_strings(names), lambda n: F.contains(x, n))
    band = F.when(has(c, "anayasa mahkemesi", "aym"), 1.0).when(has(c, "yargıtay", "danıştay"), 0.95).when(has(c, "bölge adliye"), 0.8).when(has(c, "asliye", "mahkeme"), 0.7).otherwise(0.5)
    return F.when(has(F.coalesce(source, F.lit("")), "resmi gazete", "tbmm", "parlamento", "cumhurbaşkanlığı"), F.greatest(band, F.lit(0.95))).otherwise(band)


def citation_curve(n: Column) -> Column:
    return F.when(n == 0, 0.3).when(n <= 5, 0.3 + n / 5 * 0.3).when(n <= 20, 0.6 + (n - 5) / 15 * 0.2).otherwise(F.least(0.8 + F.ln(n - 20) * 0.05, F.lit(1.0)))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    out = parts[0][0] * parts[0][1]
    for c, w in parts[1:]:
        out = out + c * w
    return out


def hybrid(keyword_: Column, semantic: Column, temporal: Column, authority: Column, citation: Column) -> Column:
    return weighted([(keyword_, 0.30), (semantic, 0.25), (temporal, 0.15), (authority, 0.15), (citation, 0.15)])


def legal_overlap(articles: Column, laws: Column, of_articles: Column, of_laws: Column, own_article: Column) -> Column:
    """0.4 times the share of a query's articles met, the same of its laws, 0.2 where the document's own article is named."""
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), F.lit(0.0))
    return F.least(share(articles, of_articles) * 0.4 + share(laws, of_laws) * 0.4 + F.when(own_article, 0.2).otherwise(0.0), F.lit(1.0))


def metadata_score(kind: Column, title: Column, query: Column) -> Column:
    boosts = F.create_map(*[F.lit(v) for pair in TYPE_BOOSTS.items() for v in pair])
    return F.least(0.5 + F.coalesce(F.try_element_at(boosts, kind), F.lit(0.0)) + F.when(F.contains(F.lower(title), F.lower(query)), 0.2).otherwise(0.0), F.lit(1.0))


def ageing(years: Column) -> Column:
    """1 less 5 % a year for five years, then 10 %; 0.5 without an age."""
    score = F.when(years <= 5, 1.0 - years * 0.05).otherwise(0.75 - (years - 5) * 0.1)
    return F.when(years.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def recency_boost(days: Column) -> Column:
    return F.when(days < 365, 1.5).when(days < 1825, 1.2).otherwise(1.0)


def citation_boost(n: Column) -> Column:
    return F.when(n >= 100, 1.3).when(n >= 50, 1.2).when(n >= 10, 1.1).otherwise(1.0)


def term_boost(document: Column, boosts: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for term, b in boosts.items():
        out = out * F.when(F.contains(F.lower(document), F.lit(term)), b).otherwise(1.0)
    return out


def half_life(age: Column, years: float = 5, floor: float = 0.1) -> Column:
    return F.greatest(F.pow(F.lit(2.0), -age / years), F.lit(floor))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from topic to weight; 0 where one is empty."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def entropy(probabilities: Column) -> Column:
    """Entropy over that of even chances."""
    h = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - p * F.ln(p + 1e-10))
    return h / F.ln(F.size(probabilities))


def level(score: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that a score reaches (highest first)."""
    out = F.lit(rest)
    for least, name in reversed(bounds):
        out = F.when(score >= least, name).otherwise(out)
    return out


def diverse(rows: Column, threshold: float, least: int) -> Column:
    """Of an array of (rank, doc_id, words) the positions kept: a row goes if it resembles a kept one by more than threshold (Jaccard), once `least` are kept."""
    alike = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x["words"], y["words"])), F.size(F.array_union(x["words"], y["words"]))), F.lit(0.0)) > threshold
    none = F.slice(rows, 1, 0)
    return F.aggregate(rows, none, lambda kept, x: F.when((F.size(kept) < least) | ~F.exists(kept, lambda y: alike(x, y)), F.concat(kept, F.array(x))).otherwise(kept))
