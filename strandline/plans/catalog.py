"""Name -> Spark query, and name -> SQL for the same result."""

from . import builder_queries, data_queries, reader_queries, retrieval_queries, trace_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (retrieval_queries, trace_queries, data_queries, builder_queries, reader_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
