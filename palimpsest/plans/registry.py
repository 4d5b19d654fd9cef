"""Names of queries -> DataFrame builders and DuckDB SQL."""

from . import browsing, lookups, merging, storage

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (merging, storage, browsing, lookups):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
