"""All queries of the library and the SQL that checks them."""

from quillmill.plans import annotation_queries, event_queries, finding_queries, graph_queries, metric_queries, place_queries, review_queries, search_queries

_MODULES = (metric_queries, finding_queries, graph_queries, event_queries, place_queries, annotation_queries, review_queries, search_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
