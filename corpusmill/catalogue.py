"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from corpusmill.plans import activity, chunks, corpus, graphs, logic, retrieval, services, texts, versions  # noqa: F401  they register their queries
from corpusmill.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
