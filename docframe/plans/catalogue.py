"""The catalogue of queries on shared tables, each with the SQL that checks it."""

from __future__ import annotations

from docframe.plans import decoded, documents, exported, formats, framed, layout, matching, metrics, rules, saving, sequences, streams, text  # noqa: F401  each registers its queries
from docframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
