"""Registered queries: one or more per operator, with SQL twins."""

from motefield.queries import aggregates, fields, filters, jobs, joins, ordering, scans, stars, streams  # noqa: F401
from motefield.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
