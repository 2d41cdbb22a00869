"""The registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from isolates.plans import annotation_queries, cohort_queries, detail_queries, more_queries, report_queries, typing_queries

QUERIES = typing_queries.QUERIES | cohort_queries.QUERIES | more_queries.QUERIES | detail_queries.QUERIES | report_queries.QUERIES | annotation_queries.QUERIES
ORACLE_SQL = typing_queries.SQL | cohort_queries.SQL | more_queries.SQL | detail_queries.SQL | report_queries.SQL | annotation_queries.SQL
FLAGSHIP = typing_queries.lineage_calls
