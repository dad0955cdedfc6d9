"""Registered queries and their SQL."""

from . import graph_queries, stream_queries, surface_queries, trace_queries, tree_queries, vector_queries

MODULES = (vector_queries, tree_queries, trace_queries, graph_queries, stream_queries, surface_queries)
CORE_QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
CORE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
