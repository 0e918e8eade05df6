"""All queries and their oracles, by name."""

from __future__ import annotations

from sceneqa.queries import extensions, geometry, joins, nested, qa, sampling, stats, text, windows  # noqa: F401
from sceneqa.queries.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
