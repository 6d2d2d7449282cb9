"""All queries over the reference tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from tessera import queries, queries_fields, queries_more, queries_pages, queries_reports, queries_rules, queries_state, queries_titles

QUERIES = queries.QUERIES | queries_rules.QUERIES | queries_fields.QUERIES | queries_more.QUERIES | queries_pages.QUERIES | queries_titles.QUERIES | queries_state.QUERIES | queries_reports.QUERIES
ORACLES = queries.ORACLES | queries_rules.ORACLES | queries_fields.ORACLES | queries_more.ORACLES | queries_pages.ORACLES | queries_titles.ORACLES | queries_state.ORACLES | queries_reports.ORACLES
FLAGSHIP = "page_host_facets"
