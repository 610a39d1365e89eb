"""Queries by name, and their SQL where there is one."""

from tessera.plans import retrieval_queries, session_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}
for part in (text_queries, retrieval_queries, session_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
