"""All queries over the driver tables, with the SQL they are checked against."""

from __future__ import annotations

from .queries import coding, evaluation, files, global_index, learned, more, relational, retrieval, runs, scoring, search, statistics  # noqa: F401  (they register)
from .queries.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
