"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from attesta.plans import changes, feeds, governed, judgments, ledgers, providers, registries, registry_graph, star, views, workspaces

_PLANS = (star, changes, feeds, providers, judgments, governed, ledgers, registries, registry_graph, views, workspaces)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
