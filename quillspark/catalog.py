"""All registered queries of the core and their SQL."""

from quillspark.plans import record_queries, retrieval_queries

MODULES = (retrieval_queries, record_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
