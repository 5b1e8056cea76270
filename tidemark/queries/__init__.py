"""All registered queries."""

from tidemark.queries import evidence, geometry, models, published, rasters, records, rollups, scans  # noqa: F401
from tidemark.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
