"""All registered queries and their oracle SQL by name."""

from changelens.plans import diff_queries, document_queries, event_queries, label_queries, small_queries, vector_queries

_MODULES = (vector_queries, label_queries, document_queries, diff_queries, small_queries, event_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
