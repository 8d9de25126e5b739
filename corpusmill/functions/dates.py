"""Column functions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")


def parse_date(x: Column) -> Column:
    """Day month-name year, d.m.y with / or - too (two-digit years from 1950 to 2049), or ISO; null for anything else."""
    x = F.lower(F.translate(F.trim(x), "İI", "iı"))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(x, r"^[0-9]{1,2} (\S+) [0-9]{4}$", 1)).cast("int")
    named = F.when(month > 0, F.concat_ws("-", F.regexp_extract(x, r"([0-9]{4})$", 1), month, F.regexp_extract(x, r"^([0-9]{1,2}) ", 1)))
    numeric = r"^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})$"
    year = F.regexp_extract(x, numeric, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 50, "20").otherwise("19"), year)).otherwise(year)
    dmy = F.when(x.rlike(numeric), F.concat_ws("-", full, F.regexp_extract(x, numeric, 2), F.regexp_extract(x, numeric, 1)))
    return F.coalesce(named, dmy, x).try_cast("date")


def format_date(d: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(d), F.element_at(F.array(*[F.lit(m.capitalize() if m[0] != "i" else m) for m in MONTHS]), F.month(d)), F.year(d))


def add_business_days(d: Column, n: int) -> Column:
    """The nth weekday after d."""
    days = F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, n * 7 // 5 + 7)), lambda x: F.weekday(x) < 5)
    return F.element_at(days, n)


def active_on(day: Column, published: Column, effective: Column, revoked: Column) -> Column:
    """From the later of publication and effect up to, not including, the day of repeal."""
    return (day >= F.greatest(published, F.coalesce(effective, published))) & (revoked.isNull() | (day < revoked))


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, as an array."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def gazette(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def mentions(x: Column) -> Column:
    """Dates in a text, as written: those with a month's name first, then numeric ones."""
    named = "[0-9]{1,2} (?:" + "|".join(m.capitalize() for m in MONTHS) + ") [0-9]{4}"
    return F.concat(F.regexp_extract_all(x, F.lit(named), F.lit(0)), F.regexp_extract_all(x, F.lit(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"), F.lit(0)))


def date_range(x: Column) -> Column:
    """Two dates around a dash: a struct of start and end."""
    parts = F.split(x, " +[-–] +")
    return F.struct(parse_date(F.get(parts, 0)).alias("start"), parse_date(F.get(parts, 1)).alias("end"))
