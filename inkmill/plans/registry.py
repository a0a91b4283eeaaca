"""All queries of the library and their DuckDB equivalents."""

from inkmill.plans import dialogue_queries, graph_queries, history_queries, retrieval_queries, text_queries, vector_queries, workflow_queries

_MODULES = (graph_queries, text_queries, vector_queries, dialogue_queries, workflow_queries, retrieval_queries, history_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
