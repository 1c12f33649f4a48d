"""Registered queries: ``QUERIES[name](spark, sf_dir)`` and ``ORACLE[name]`` (DuckDB SQL)."""

from . import chains, jobs, reports, streams  # noqa: F401  (register items 1-48)
from .registry import AS_OF, ORACLE, QUERIES

__all__ = ["AS_OF", "ORACLE", "QUERIES"]
