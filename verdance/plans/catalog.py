"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from .queries import QUERIES, SQL

FLAGSHIP = "ndvi_keep_counts"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["FLAGSHIP", "QUERIES", "oracle_sql"]
