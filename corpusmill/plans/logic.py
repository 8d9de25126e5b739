"""Logic of articles: lines of documents stand for articles, with rules put before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import logic
from corpusmill.plans.registry import query
from corpusmill.session import table

#: What is put before a document's lines, in turn; {r} and {s} are numbers of lines, {t} a term.
RULES = (
    "taşıyıcı {t} gün içinde bildirim yapmak zorundadır. ", "taşıyıcı için bildirim yasaktır. ", "", "alıcı sadece imza ile yükümlüdür. ", "", "koşul halinde ", "taşıyıcı sadece belge ile kabul edilir. ",
    "hem açık hem de olmayan halde ise ", "", "bu kapsam taşıyıcı ve alıcı ", "taşıyıcı hariç, gemi hariç ", "alıcı 01.02.2020 tarihinden önce ", "", "alıcı yalnızca öncelikle yükümlüdür. ", "alıcı 01.02.2020 tarihinden sonra ",
    "satıcı yalnızca pazar günü gelir. ", "", "gemi {t} ay içinde uymak zorundadır; {r}. madde olduğunda ", "gemi kullanılamaz. ", "eğer {s}. madde geçerliyse ", "taşıyıcı {t} gün içinde ödeme yapmak zorundadır. ", "", "",
)


def ruled_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, place, number, content: each line with a rule before it. {r} is the next line, the one after it or the line itself, {s} the line before the last."""
    docs = table(spark, d, "documents").filter("doc_id is not null and text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    i = F.col("place")
    rule = F.element_at(F.array(*[F.lit(r) for r in RULES]), (F.pmod(i + F.col("doc_id"), F.lit(len(RULES))) + 1).cast("int"))
    third = F.pmod(i, F.lit(3))
    named = i + F.when(third == 0, 2).when(third == 1, 3).otherwise(1)
    put = {"{r}": named.cast("string"), "{s}": (i - 1).cast("string"), "{t}": F.when(F.pmod(i, F.lit(2)) == 0, "30").otherwise("60")}
    for mark, value in put.items():
        rule = F.replace(rule, F.lit(mark), value)
    return lines.select("doc_id", "place", (i + 1).cast("string").alias("number"), F.concat(rule, "line").alias("content"))


@query()
def logic_findings(spark: SparkSession, d: str) -> DataFrame:
    """Articles that contradict or exclude others of their document, and conditions, terms, exemptions and dates that don't fit. The tests hold it against plain loops over pairs."""
    return logic.findings(ruled_lines(spark, d))


@query()
def inherited_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Articles bound both ways by what they name in conditions. The tests hold it against a plain search."""
    return logic.inherited_contradictions(ruled_lines(spark, d))


@query()
def circular_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose references lead back to them. The tests hold it against a plain search."""
    return logic.circular_references(ruled_lines(spark, d))
