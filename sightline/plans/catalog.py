"""All registered queries."""

from __future__ import annotations

from . import event_queries, file_queries, geometry_queries, pose_queries, table_queries, time_queries, track_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
