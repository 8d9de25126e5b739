"""Column functions over text: cleaning, masking, tokens, checks. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Letters and their plain forms, patterns of personal data.
TURKISH, PLAIN = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
PHONE = r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{2,4}"
NATIONAL_ID = r"\b[1-9][0-9]{10}\b"
#: Runs of letters, their marks and digits of any script.
WORD = r"[\p{L}\p{M}\p{N}]+"
MOJIBAKE = r"Ã.|Ä.|Å.|�"


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def latinize(x: Column) -> Column:
    return F.translate(x, TURKISH, PLAIN)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(latinize(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def tokens(x: Column, pattern: str = r"[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0))


def sentences(x: Column) -> Column:
    """Stretches that end in . ! or ? or at the end of the text."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def mask_email(x: Column) -> Column:
    # a match begins where a run of its letters does, or where the last match ended, and gives nothing back: each letter is looked at once
    run = r"[A-Za-z0-9._%+-]"
    masked = F.regexp_replace(x, rf"(?:\G|(?<!{run}))({run}{{1,3}}+){run}*+@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})", "$1***@$2")
    return F.when(F.contains(x, F.lit("@")), masked).otherwise(x)


def mask_ip(x: Column) -> Column:
    return F.regexp_replace(x, r"([0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "$1.*.*.*")


def mask_card(x: Column) -> Column:
    return F.regexp_replace(x, r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})", "****-****-****-$1")


def mask_national_id(x: Column) -> Column:
    return F.regexp_replace(x, r"\b[1-9][0-9]{8}([0-9]{2})\b", "*********$1")


def mask_personal(x: Column, email: bool = True, ip: bool = True, card: bool = True, national_id: bool = True) -> Column:
    for on, mask in ((card, mask_card), (national_id, mask_national_id), (email, mask_email), (ip, mask_ip)):
        x = mask(x) if on else x
    return x


def _digits(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: c.cast("int"))


def valid_national_id(x: Column) -> Column:
    """Eleven digits, the last two of which check the others."""
    d = lambda i: F.substring(x, i, 1).cast("int")
    odd, even = sum((d(i) for i in (3, 5, 7, 9)), d(1)), sum((d(i) for i in (4, 6, 8)), d(2))
    tenth, last = F.pmod(odd * 7 - even, F.lit(10)), F.pmod(odd + even + d(10), F.lit(10))
    return F.coalesce(F.when(x.rlike(r"^[1-9][0-9]{10}$"), (tenth == d(10)) & (last == d(11))), F.lit(False))


def valid_iban(x: Column, country: str = "TR", length: int = 26) -> Column:
    """Remainder 1 modulo 97 of the rearranged digits."""
    compact = F.upper(F.regexp_replace(x, " ", ""))
    moved = F.concat(F.substring(compact, 5, length), F.lit("".join(str(ord(c) - 55) for c in country)), F.substring(compact, 3, 2))
    rest = F.aggregate(_digits(moved), F.lit(0), lambda a, b: F.pmod(a * 10 + b, F.lit(97)))
    return F.coalesce(F.when(compact.rlike(f"^{country}[0-9]{{{length - 2}}}$"), rest == 1), F.lit(False))


def readability(x: Column) -> Column:
    """100 less twice (1.5 letters a word + 0.5 words a sentence), between 0 and 100; 0 without words."""
    words, n = F.regexp_count(x, F.lit(r"[A-Za-z0-9]+")), F.greatest(F.regexp_count(x, F.lit(r"[.!?]+")), F.lit(1))
    letters = F.length(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))
    score = 100 - 2 * (1.5 * letters / words + 0.5 * words / n)
    return F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def snippet(x: Column, word: str, length: int = 300) -> Column:
    """A window around the first hit, with dots where it is cut; the start of the text without a hit."""
    at = F.locate(word, F.lower(x))
    start = F.greatest(F.lit(1), F.when(at > 0, at - length // 2).otherwise(1))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(x, start, F.lit(length)), F.when(start + length <= F.length(x), "...").otherwise(""))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), "\r\n", "\n") for p in parts]), 256)


def rollout(key: Column, flag: str) -> Column:
    """A share from 0 to 1 that a key and a flag's name fix."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(flag + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(10_000)) / 10_000


def first_matching(x: Column, patterns: dict[str, str], rest: str) -> Column:
    """The name of the first pattern that occurs in x."""
    out = F.lit(rest)
    for name, pattern in reversed(patterns.items()):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def sections_by(df: DataFrame, key: str, text: str, heading: Column) -> DataFrame:
    """key, line, start, stop of each line (column `line`) that is a heading, up to the next one or the end, counted in characters."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.length(text).cast("long").alias("size_"), F.posexplode(F.split(text, "\n")).alias("i_", "line"))
    upto = W.partitionBy(key).orderBy("i_")
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.filter(heading).withColumn("stop", F.coalesce(F.lead("start").over(W.partitionBy(key).orderBy("start")), F.col("size_"))).drop("size_", "i_")


def legal_numbers(x: Column) -> dict[str, Column]:
    """Mentions of laws, articles, cases (esas and karar numbers) and gazettes."""
    law = r"[0-9]{3,5} +sayılı"
    case_no = F.concat_ws(" ", F.regexp_extract(x, r"E[.] *No: *([0-9]{4}/[0-9]+)", 1), F.regexp_extract(x, r"K[.] *No: *([0-9]{4}/[0-9]+)", 1))
    return {
        "law": F.get(F.regexp_extract_all(x, F.lit(law), F.lit(0)), 0), "article": F.regexp_extract(x, r"Madde +([0-9]+)", 1), "case_no": case_no,
        "gazette": F.regexp_extract(x, r"RG No: *([0-9]+)", 1), "is_law": x.rlike(law), "is_court": x.rlike("Yargıtay|Danıştay"),
    }


def entities(x: Column) -> Column:
    """The three character references that markup always needs, put back."""
    return F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
