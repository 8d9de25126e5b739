"""Articles as trees of paragraphs, clauses and subclauses, a row for each node.

Each level is one generator over the pieces of the level above, so a tree is rows with
a path from the beginning; marks that repeat below one parent are told apart by a window
over rows of that parent and mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Marks of paragraphs, clauses and subclauses, and what paths call the levels.
PARAGRAPH = r"\(\d+\)\s*"
CLAUSE = "[a-zçğıİöşü]"
ROMAN, NUMBER = "(?i:[ivxlcdm]+)", "[0-9]+"
LEVELS = {"article": "M", "paragraph": "F", "clause": "B", "subclause": "AB"}


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _marked(x: Column, mark: str, indent: str) -> Column:
    """(number, content) of every part of x that begins with `mark)` at the beginning of a line; text before the first is none's."""
    pattern = rf"(?ms)^{indent}({mark})\)\s+(.+?)(?=\n{indent}{mark}\)|\z)"
    numbers, contents = (F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(numbers.alias("a"), contents.alias("b")), lambda p: F.struct(p["a"].alias("number"), _strip(p["b"]).alias("content")))


def paragraphs(x: Column) -> Column:
    """Parts of an article by `(1)`, numbered in order; what lies before the first mark is a paragraph too, and blank parts are none."""
    parts = F.filter(F.transform(F.split(x, PARAGRAPH, -1), _strip), lambda p: p != "")
    one = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    return F.transform(one, lambda p, i: F.struct((i + 1).cast("string").alias("number"), p.alias("content")))


def clauses(x: Column) -> Column:
    return _marked(x, CLAUSE, "")


def subclauses(x: Column) -> Column:
    """By roman numerals, or else by numbers; their lines may be indented."""
    roman = _marked(x, ROMAN, r"[ \t]*")
    return F.when(F.size(roman) > 0, roman).otherwise(_marked(x, NUMBER, r"[ \t]*"))


def clause_tree(articles: DataFrame, key: str = "doc_id", number: str = "number", content: str = "content") -> DataFrame:
    """key, kind, number, level, path, parent_path, lead, content: articles, and below each its paragraphs, clauses and subclauses.

    content is the text of a node without clauses (a clause keeps the text of its
    subclauses); lead is what a node says before its first child. Paths number
    repeated marks of one parent apart (`B.a`, then `B.a-2`). Null contents and
    numbers have no row.
    """
    some = articles.filter(F.col(content).isNotNull() & F.col(number).isNotNull())
    at = lambda kind, n: F.concat(F.lit(LEVELS[kind] + "."), n)
    top = some.select(F.col(key), F.lit("article").alias("kind"), F.col(number).cast("string").alias("number"), F.lit(0).alias("level"), at("article", F.col(number).cast("string")).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("").alias("lead"), F.lit("").alias("content"), F.col(content).alias("whole"))

    def below(above: DataFrame, kind: str, parts: Column) -> DataFrame:
        rows = above.select(key, F.col("path").alias("parent_path"), F.col("level"), F.posexplode(parts).alias("at_", "p"))
        name = F.col("p.number")
        if kind != "paragraph":  # those are numbered in order; other marks may repeat
            copy = F.row_number().over(W.partitionBy(key, "parent_path", "p.number").orderBy("at_"))
            rows = rows.withColumn("copy_", copy)
            name = F.concat(name, F.when(F.col("copy_") > 1, F.concat(F.lit("-"), F.col("copy_").cast("string"))).otherwise(""))
        return rows.select(key, F.lit(kind).alias("kind"), F.col("p.number").alias("number"), (F.col("level") + 1).alias("level"), F.concat("parent_path", F.lit("/"), at(kind, name)).alias("path"), "parent_path", F.lit("").alias("lead"), F.col("p.content").alias("content"), F.col("p.content").alias("whole"))

    lead = lambda mark, indent: F.regexp_replace("whole", rf"(?ms)^{indent}(?:{mark})\)\s.*\z", "")
    para = below(top, "paragraph", paragraphs(F.col("whole")))
    clause = below(para, "clause", clauses(F.col("whole")))
    sub = below(clause, "subclause", subclauses(F.col("whole")))
    with_clauses = F.size(clauses(F.col("whole"))) > 0
    para = para.withColumns({"lead": F.when(with_clauses, _strip(lead(CLAUSE, ""))).otherwise(F.col("whole")), "content": F.when(with_clauses, "").otherwise(F.col("whole"))})
    roman = F.size(_marked(F.col("whole"), ROMAN, r"[ \t]*")) > 0
    clause = clause.withColumn("lead", _strip(F.when(roman, lead(ROMAN, r"[ \t]*")).when(F.size(subclauses(F.col("whole"))) > 0, lead(NUMBER, r"[ \t]*")).otherwise(F.col("whole"))))
    sub = sub.withColumn("lead", F.col("whole"))
    return top.unionByName(para).unionByName(clause).unionByName(sub).drop("whole")
