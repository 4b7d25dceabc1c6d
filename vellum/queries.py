"""All queries of the library by name, and the oracle SQL of those that have one."""

from __future__ import annotations

from .plans import checks_queries, corpus_queries, engine_queries, formatting_queries

_ALL = {**checks_queries.Q, **formatting_queries.Q, **corpus_queries.Q, **engine_queries.Q}

QUERIES = {name: fn for name, (fn, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
