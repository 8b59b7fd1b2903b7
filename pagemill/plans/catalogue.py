"""Registered queries and their oracle SQL, from the modules of this folder."""

from pagemill.plans import documents, health, library, operations, reporting, retrieval, search_sql, stores

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (retrieval, documents, library, reporting, operations, stores, health):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
ORACLE_SQL |= search_sql.SQL
