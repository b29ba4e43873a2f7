"""Fixed parameters of the registered queries over the driver's tables.

The bound data spans 1995-1996 order dates to 2001 ship dates; ``as_of``
replaces the wall clock so every result is repeatable.
"""

from __future__ import annotations

import datetime as dt

# Fixed values.
AS_OF = dt.datetime(1997, 1, 8)              # general "now"
AS_OF_NEW_YEAR = dt.datetime(2001, 1, 3)     # week buckets across New Year
# Whole history: every worklog/issue of the bound tables is inside.
ALL_START = dt.datetime(1990, 1, 1)
ALL_STOP = dt.datetime(2009, 12, 31, 23, 59, 59)
# One week of the timesheet (8 day boundaries -> 7 day columns).
SHEET_START = dt.datetime(1997, 1, 1)
SHEET_STOP = dt.datetime(1997, 1, 8)
# Two years of it.
SHEET_TWO_YEARS = dt.datetime(1999, 1, 1)
# A quarter of the timesheet, for the long-form grid.
GRID_START = dt.datetime(1997, 1, 1)
GRID_STOP = dt.datetime(1997, 4, 1)
# Open-issue age threshold of R1, in days.
OPEN_OLDER_THAN_DAYS = 90

# Names of the user table of F3; first day of an explicit range.
USERS_OF_NATION = "FRANCE"
EXPLICIT_START = "1996-12-30"


def sql_ts(value: dt.datetime) -> str:
    """DuckDB timestamp literal."""
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def sql_date(value) -> str:
    if isinstance(value, dt.datetime):
        value = value.date()
    return f"DATE '{value.isoformat()}'"
