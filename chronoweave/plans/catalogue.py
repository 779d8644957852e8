"""All queries of the engine and their DuckDB text."""

from __future__ import annotations

from chronoweave.plans import facts, names, reads, requests, states

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for part in (reads, names, facts, states, requests):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
