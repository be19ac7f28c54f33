"""The registered queries: operators applied to the given tables, with their SQL twins."""

from casewright.catalog import answer_queries, cohort_queries, eval_queries, store_queries, text_queries

_MODULES = [cohort_queries, text_queries, answer_queries, eval_queries, store_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
