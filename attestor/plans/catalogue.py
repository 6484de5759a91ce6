"""Every query of the engine by name, with the SQL that gives the same rows."""

from . import address_queries, case_queries, check_queries, landed_queries, lead_queries, link_queries, mention_queries, pacing_queries, page_queries, pivot_queries, profile_queries, report_queries, scrub_queries, store_queries

_MODULES = (case_queries, page_queries, link_queries, lead_queries, landed_queries, report_queries, check_queries, pivot_queries, profile_queries, address_queries, mention_queries, scrub_queries, store_queries, pacing_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
