"""All queries of the retrieval engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from skerry.plans import catalog_search, catalog_stores, catalog_text, catalog_usage

_ALL = {**catalog_search.QUERIES, **catalog_usage.QUERIES, **catalog_text.QUERIES, **catalog_stores.QUERIES}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
flagship = catalog_search.hybrid_search
