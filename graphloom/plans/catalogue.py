"""All queries of the library and their DuckDB forms, by name."""

from . import graph_queries, text_queries

QUERIES = text_queries.QUERIES | graph_queries.QUERIES
ORACLES = text_queries.ORACLES | graph_queries.ORACLES
