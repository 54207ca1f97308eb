"""Queries over the driver's tables, and the SQL that they must agree with."""

from parley.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
