"""Every query of the engine by name, with the SQL that it is held against."""

from __future__ import annotations

from tidemark.plans import crawl_queries, page_queries, search_queries, work_queries

FLAGSHIP = "hybrid_union_rerank"
_SPECS = search_queries.SPECS | crawl_queries.SPECS | work_queries.SPECS | page_queries.SPECS
QUERIES = {name: query for name, (query, _) in _SPECS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _SPECS.items() if sql}
