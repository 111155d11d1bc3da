"""All queries of the engine's own operators, with their SQL twins."""

from __future__ import annotations

from tessera.plans import chunks, code, graphs, lifecycle, project, routes, scalars, search

_MODULES = (scalars, chunks, code, search, graphs, lifecycle, routes, project)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = search.hybrid_search
