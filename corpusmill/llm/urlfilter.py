"""URL filters: pattern rules indexed by their rarest literal token.

Rules are host-and-path rules or regular expressions. An expression is parsed and
written out as its alternatives; of each, the whole tokens (runs of letters and digits)
that every url it fits must hold are taken, which are literal runs between boundaries
or other characters. How often tokens occur is counted over all urls, and a rule is put
in the index under the rarest token of each of its alternatives. The tokens of a url
fetch the rules indexed under them, and only those are tested. Rules of which some
alternative has no such token, or that can't be parsed, are fetched by every url.

Defined results: null urls and those without `://` have empty host and path and
no rule, and the verdict `allow`; of several fitting host-and-path rules the
longest wins; patterns decide only where none of those fits; repeated rows agree;
an empty table gives an empty one; other columns are not read. Urls that share host
and path (all without a host, say) are judged once and told in salted parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import told

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules broadcast at most; larger rule sets are joined by a shuffle on the token.
BROADCAST_RULES = 100_000


#: Alternatives that an expression is written out in at most; what goes beyond counts as anything.
MOST_ALTERNATIVES = 64
_ALNUM = set("abcdefghijklmnopqrstuvwxyz0123456789")
#: Parts of a written-out expression beside single letters and digits: a place or character that ends a token, and anything.
EDGE, ANYTHING = "edge", "anything"


def _ends_token(members: list) -> bool:
    """Is no member of a character class a letter or digit?"""
    for op, arg in members:
        name = str(op)
        if name == "LITERAL":
            if chr(arg) in _ALNUM:
                return False
        elif name == "RANGE":
            if any(chr(c) in _ALNUM for c in range(arg[0], min(arg[1], 127) + 1)):
                return False
        elif not (name == "CATEGORY" and str(arg) in ("CATEGORY_SPACE", "CATEGORY_NOT_WORD")):
            return False
    return True


def _written_out(tree) -> list[tuple[str, ...]]:
    """The alternatives of a parsed expression, as parts in order; at most MOST_ALTERNATIVES."""
    out: list[tuple[str, ...]] = [()]
    for op, arg in tree:
        name, each = str(op), [(ANYTHING,)]
        if name == "LITERAL":
            each = [(chr(arg),) if chr(arg) in _ALNUM else (EDGE,)]
        elif name == "AT":
            each = [(EDGE,)] if str(arg) in ("AT_BOUNDARY", "AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING") else [(ANYTHING,)]
        elif name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                each = [(chr(c),) if chr(c) in _ALNUM else (EDGE,) for _, c in arg]
            else:
                each = [(EDGE,) if _ends_token(arg) else (ANYTHING,)]
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            each = _written_out(arg[3])
        elif name == "BRANCH":
            each = [parts for branch in arg[1] for parts in _written_out(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, part = arg
            if least:
                inner = _written_out(part)
                again = 1 if len(inner) > 1 else min(least, 8)
                each = [parts * again + ((ANYTHING,) if most > again else ()) for parts in inner]
            elif most == 1:
                each = [(), *_written_out(part)]
        if len(out) * len(each) > MOST_ALTERNATIVES:
            each = [(ANYTHING,)]
        out = [a + b for a in out for b in each]
    return out


def _whole_tokens(parts: tuple[str, ...]) -> list[str]:
    """Runs of letters and digits with an edge on either side."""
    found, run, open_ = [], "", False
    for part in (*parts, ANYTHING):
        if part in _ALNUM:
            run += part
            continue
        if run and open_ and part == EDGE:
            found.append(run)
        run, open_ = "", part == EDGE
    return found


def mandatory_tokens(pattern: str) -> list[list[str]]:
    """For each alternative of the expression the tokens that every fitting url holds; nothing where some alternative has none."""
    if re.search(r"\\b\{|\(\?[a-zA-Z-]*[imsuxU]", pattern):  # flags, and what the two dialects read differently
        return []
    try:
        tree = re._parser.parse(pattern)  # the standard library's own parser of expressions
    except (re.error, OverflowError, RecursionError):
        return []
    each = [_whole_tokens(parts) for parts in _written_out(tree)]
    return each if all(each) else []


@dataclass(frozen=True)
class UrlRule:
    """host and path prefix, or pattern (over host and path in lower case); verdict is allow or block."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    def tokens(self) -> list[list[str]]:
        """For each alternative, tokens of which every url that it fits holds all; an empty list where nothing is known."""
        if self.pattern:
            return mandatory_tokens(self.pattern)
        # the path is a prefix, so its last run may go on unless a separator follows
        found = re.findall(r"[a-z0-9]+", self.host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.path.lower())
        return [found] if found else []


BASE_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: Patterns for urls that no base rule fits. \b marks the ends of whole tokens.
PATTERNS = tuple(
    UrlRule("block", pattern=p)
    for p in (r"\bads\b", r"\btracker\b", r"\bdoubleclick\b", r"\bpopup\b", r"\bcasino\b", r"\bxxx\b", r"\blogin\b[^/]*$", r"\bnet\b/it/", r"\borg\b/es/[0-9]+$")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host, path), UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = BASE_RULES + PATTERNS, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (name of the fitting host-and-path rule, else null), verdict, pattern (that fitted, else null)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = urls.withColumn("token", F.explode(_url_tokens(F.col("host"), F.col("path"))))

    rows = [(i, j, r.verdict, r.host, r.path, r.pattern, r.name, t) for i, r in enumerate(rules) for j, each in enumerate(r.tokens() or [[None]]) for t in each]
    given = spark.createDataFrame(rows, "n int, alternative int, verdict string, r_host string, r_path string, pattern string, name string, token string")
    small = len(rows) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    # how many urls have each token that a rule offers
    offered = given.select("token").distinct()
    often = tokens.join(hint(offered), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        given.join(often.withColumnRenamed("token", "t_"), F.col("token") == F.col("t_"), "left")
        .groupBy("n", "alternative", "verdict", "r_host", "r_path", "pattern", "name")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )
    fit_host = (F.col("host") == F.col("r_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("r_host")))
    fit = F.when(F.col("pattern") == "", fit_host & F.startswith(F.col("path"), F.col("r_path"))).otherwise(
        F.expr("translate(concat(host, path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike pattern")
    )
    distinct = urls.select("host", "path").distinct()
    asked = distinct.withColumn("token", F.explode(F.concat(_url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
    indexed = rarest.withColumn("token", F.coalesce("token", F.lit(""))).drop("alternative").distinct()
    found = (
        asked.join(hint(indexed), "token")
        .filter(fit)
        .groupBy("host", "path")
        .agg(
            F.max_by(F.struct("name", "verdict"), F.when(F.col("pattern") == "", F.struct(F.length("name"), "name"))).alias("base"),
            F.min(F.when(F.col("pattern") != "", F.struct("n", "name", "verdict"))).alias("more"),
        )
        .select("host", "path", "base", "more")
    )
    return told(urls, found, ["host", "path"], "page_id", "left").select(
        "page_id",
        "host",
        "path",
        F.col("base.name").alias("rule"),
        F.coalesce("base.verdict", "more.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("base").isNull(), F.col("more.name")).alias("pattern"),
    )
