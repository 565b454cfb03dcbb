"""The catalogue of queries and the SQL each is checked against."""

from codegrove.plans import aggregates, calls, contract, lookups, overlays, patches, reducers, reports, rescue, shapes, sources, structure  # noqa: F401
from codegrove.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
