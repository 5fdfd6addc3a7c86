"""All queries of the core library with the SQL that must give the same rows."""

from lodestone.plans import analysis_queries, graph_queries, parser_queries, record_queries, search_queries

MODULES = [record_queries, search_queries, parser_queries, graph_queries, analysis_queries]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
