"""Column functions that check and tidy fields: numbers of persons, phones, addresses, files, delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_tax_number(x: Column) -> Column:
    """Ten digits, the last of which checks the first eight."""
    compact = F.regexp_replace(x, "[ -]", "")

    def term(i: int) -> Column:
        t = F.pmod(F.substring(compact, i + 1, 1).cast("int") + (9 - i), F.lit(10))
        r = F.pmod(t * (1 << (8 - i)), F.lit(9))
        return r + F.when((t != 0) & (r == 0), 9).otherwise(0)

    total = sum((term(i) for i in range(1, 8)), term(0))
    check = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))
    return F.coalesce(F.when(compact.rlike("^[0-9]{10}$"), check == F.substring(compact, 10, 1).cast("int")), F.lit(False))


def local_phone(x: Column) -> Column:
    """Without blanks, dashes, brackets and the country's or trunk prefix."""
    bare = F.regexp_replace(x, r"[\t-\r ()-]", "")
    return F.when(F.startswith(bare, F.lit("+90")), F.substring(bare, 4, 99)).when(F.startswith(bare, F.lit("90")), F.substring(bare, 3, 99)).when(F.startswith(bare, F.lit("0")), F.substring(bare, 2, 99)).otherwise(bare)


def valid_phone(x: Column) -> Column:
    return F.coalesce(local_phone(x).rlike("^5[0-9]{9}$"), F.lit(False))


def format_phone(x: Column) -> Column:
    p = local_phone(x)
    part = lambda a, n: F.substring(p, a, n)
    return F.when(valid_phone(x), F.concat_ws(" ", F.lit("+90"), part(1, 3), part(4, 3), part(7, 2), part(9, 2))).otherwise(p)


def mask_phones(x: Column, pattern: str) -> Column:
    """Only the last four digits of what the pattern (its last group) finds stay."""
    return F.regexp_replace(x, pattern, "*** *** $1")


def valid_email(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False))


def valid_url(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^https?://[^\t-\r /$.?#].[^\t-\r ]*$"), F.lit(False))


def file_extension(x: Column) -> Column:
    return F.when(F.contains(x, F.lit(".")), F.lower(F.substring_index(x, ".", -1))).otherwise("")


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_\t-\r .-]", ""), r"[\t-\r _]+", "_")


def cut_off(x: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(x) <= length, x).otherwise(F.concat(F.substring(x, 1, length - len(suffix)), F.lit(suffix)))


def within_tokens(x: Column, limit: int) -> Column:
    """At most so many tokens of four characters, dots where it is cut."""
    return F.when(F.floor(F.length(x) / 4) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit * 4), F.lit("...")))


def compressed(x: Column, stop_words: tuple[str, ...], share: float = 0.7) -> Column:
    """White space collapsed; words of no weight left out where more than `share` of the length remains."""
    one = F.regexp_replace(x, r"[\t-\r ]+", " ")
    kept = F.array_join(F.filter(F.split(one, " "), lambda w: ~F.lower(w).isin(*stop_words)), " ")
    return F.trim(F.when(F.length(one) > share * F.length(x), kept).otherwise(one))


def delay_days(x: Column) -> Column:
    """Days of an expression like `30 gün sonra`: months count 30, years 365; null for anything else."""
    found = r"([0-9]+)[\t-\r ]*(gün|ay|yıl)[\t-\r ]*sonra"
    unit = F.regexp_extract(F.lower(x), found, 2)
    return F.regexp_extract(F.lower(x), found, 1).try_cast("int") * F.when(unit == "gün", 1).when(unit == "ay", 30).when(unit == "yıl", 365)


def relative_date(x: Column, today: Column) -> Column:
    """The day that a phrase means, counted from today; null for anything else. Months keep the day where they have it."""
    t = F.trim(F.lower(x))
    has = lambda p: F.contains(t, F.lit(p))
    return (
        F.when(t == "bugün", today).when(t == "dün", F.date_sub(today, 1)).when(t == "yarın", F.date_add(today, 1)).when(has("geçen hafta"), F.date_sub(today, 7)).when(has("gelecek hafta"), F.date_add(today, 7))
        .when(has("geçen ay"), F.add_months(today, -1)).when(has("gelecek ay"), F.add_months(today, 1))
    )


def clean_lines(x: Column, skip: tuple[str, ...]) -> Column:
    """Lines trimmed; blank ones, bare numbers, those under three characters and those that hold a word to skip are left out."""
    lines = F.transform(F.split(x, "\n"), lambda line: F.regexp_replace(line, r"^[\t-\r ]+|[\t-\r ]+$", ""))
    keep = F.filter(lines, lambda line: (F.length(line) >= 3) & ~line.rlike("^[0-9]+$") & ~F.lower(line).rlike("|".join(w.replace(".", "[.]") for w in skip)))
    return F.array_join(keep, "\n")


def tidy_spaces(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " {2,}", " "), "\n{3,}", "\n\n"), r"^[\t-\r ]+|[\t-\r ]+$", "")


def is_heading(x: Column) -> Column:
    """Letters and no small ones, over three characters, or a line that begins with a word for a part of a law."""
    t = F.trim(x)
    return ((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 3)) | F.upper(t).rlike("^(MADDE|BÖLÜM|KISIM|EK|GEÇİCİ)")
