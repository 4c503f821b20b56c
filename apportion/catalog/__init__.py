"""Named queries over the test tables, each beside the SQL that must agree."""

from apportion.catalog import assignment, matrix, scoring, sources, streams, tasks
from apportion.catalog.registry import oracles, queries

__all__ = ["assignment", "matrix", "oracles", "queries", "scoring", "sources", "streams", "tasks"]
