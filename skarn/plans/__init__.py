"""The engine's own queries, each with the SQL of an independent oracle."""

from __future__ import annotations

from . import analytic, relational, scalar, streams

ALL = [*relational.QUERIES, *analytic.QUERIES, *scalar.QUERIES, *streams.QUERIES]
QUERIES = {q.name: q for q in ALL}
if len(QUERIES) != len(ALL):
    raise ValueError("query names repeat")
ORACLE_SQL = {q.name: q.oracle_sql for q in ALL if q.oracle_sql}
