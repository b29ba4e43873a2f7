"""Registry of the queries run over the driver's tables, and their oracles.

A query without an oracle entry is checked by row count only (and by a
brute-force test on a fixture in ``tests/``).
"""

from __future__ import annotations

from hourbook.plans.ingest_queries import (INGEST_QUERIES, REFRESH_QUERIES, ingest_sql,
                                           refresh_sql)
from hourbook.plans.oracle import report_sql
from hourbook.plans.reports import REPORT_QUERIES
from hourbook.plans.stream_queries import STREAM_QUERIES, stream_sql

QUERIES = {**REPORT_QUERIES, **INGEST_QUERIES, **REFRESH_QUERIES, **STREAM_QUERIES}
ORACLE_SQL = {**report_sql(), **ingest_sql(), **refresh_sql(), **stream_sql()}

_missing = set(ORACLE_SQL) - set(QUERIES)
assert not _missing, f"oracle without query: {_missing}"
