"""Conditions as Columns: optional ones, ranges, membership, access, policies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "not_in": lambda c, v: ~c.isin(v),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "matches": lambda c, v: c.rlike(v),
}


def condition(field: str, op: str, value: object) -> Column:
    """One condition by the name of its operator."""
    return OPERATORS[op](F.col(field), value)


def every(conditions: list[Column | None]) -> Column:
    """All conditions given; None is no condition."""
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def within(day: Column, start=None, end=None) -> Column:
    """Inclusive range; a missing day passes."""
    return day.isNull() | every([None if start is None else day >= F.lit(start).cast("timestamp"), None if end is None else day <= F.lit(end).cast("timestamp")])


def any_of(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(x) for x in wanted]))


def all_of(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), tags)) == 0


def found_in(word: str, *columns: Column) -> Column:
    """Does any column hold the word, in either case?"""
    return reduce(Column.__or__, [c.ilike(f"%{word}%") for c in columns])


def may_see(owner: Column, user, level: Column, levels: list[str]) -> Column:
    """Rows of the user, and those of an open level."""
    return (owner == F.lit(user)) | level.isin(levels)


def decide(superuser: Column, policies: list[Column]) -> Column:
    """Superusers may; others need every policy, of which null abstains."""
    return superuser | every([F.coalesce(p, F.lit(True)) for p in policies])


def listed(address: Column, allowed: list[str] | None) -> Column:
    """Null (abstains) without a list, false without an address, else membership."""
    return F.lit(None).cast("boolean") if allowed is None else F.coalesce(address.isin(allowed), F.lit(False))


def in_business_hours(ts: Column) -> Column:
    return F.hour(ts).between(9, 17)


def variant(share: Column, shares: dict[str, float]) -> Column:
    """The variant in whose range of running shares a value from 0 to 1 falls; null beyond."""
    out, total = F.lit(None).cast("string"), sum(shares.values())
    for name, part in reversed(shares.items()):
        out = F.when(share < total, name).otherwise(out)
        total -= part
    return out


def page_of(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, each with total, pages and whether more follow; only the page is collected in order."""
    total = df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"), (F.col("total") > number * size).alias("has_next"))  # one row
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))
