"""All registered queries. Importing this module imports every plan module."""

from __future__ import annotations

from lexstrata.plans import checked, checked_ops, corpus, feeds, reports, searching, trends, vectors
from lexstrata.plans.registry import ORACLES, QUERIES, Query

MODULES = (checked, checked_ops, corpus, feeds, reports, searching, trends, vectors)


def queries() -> dict[str, Query]:
    """Query functions by name."""
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(ORACLES)
