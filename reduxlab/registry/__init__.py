"""Named queries over the given tables and the SQL each of them must agree with."""

from . import data_queries, model_queries, reduction_queries, report_queries

_PARTS = (data_queries, reduction_queries, model_queries, report_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
