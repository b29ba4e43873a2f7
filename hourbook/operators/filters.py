"""Filters and predicates (F1-F8). Each returns a lazily filtered DataFrame;
range and equality filters on plain columns reach the Parquet scan as
``PushedFilters``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.functions import exprs as X

# Fixed values of the jobs.
RECENT_WEEKS_DAYS = 35               # A6 window: today - 35 days


def _ts_lit(value) -> Column:
    """Wall-clock literal as TIMESTAMP_NTZ, built from text so no Python or
    session time zone can shift it."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


ts_lit = _ts_lit


def new_worklogs(feed: DataFrame, max_worklog_id: int | None) -> DataFrame:
    """feed rows whose worklogId is above the cursor (none: keep all)."""
    if max_worklog_id is None:
        return feed
    return feed.where(F.col("worklogId") > F.lit(int(max_worklog_id)))


def updates_since(feed: DataFrame, since_ms) -> DataFrame:
    """S1's lower bound: keep feed rows with updatedTime >= since (ms)."""
    if since_ms is None:
        return feed
    bound = since_ms if isinstance(since_ms, Column) else F.lit(int(since_ms))
    return feed.where(F.col("updatedTime") >= bound)


def filter_users(df: DataFrame, users: Iterable[str] | DataFrame | None,
                 author_col: str = "author") -> DataFrame:
    """keep rows whose author is in the list, case-insensitive.

    No names at all keep everything, given as a list or as a DataFrame. A
    list is tested in place, whatever its length; a DataFrame of names
    (first column) becomes a join on the lower-cased name beside a count of
    the names, which is the form for names that don't fit a query text. No
    job runs while the plan is built.
    """
    if users is None:
        return df
    if isinstance(users, DataFrame):
        names = users.select(F.lower(F.col(users.columns[0])).alias("_user")).distinct()
        none = users.agg(F.count(F.lit(1)) == 0).scalar()
        listed = df.withColumn("_user", F.lower(F.col(author_col))).join(names.withColumn("_listed", F.lit(True)), "_user", "left")
        return listed.where(F.col("_listed") | none).drop("_user", "_listed")
    users = list(users)
    return df.where(X.lower_in(author_col, users)) if users else df


def in_date_range(df: DataFrame, column: str, start, stop) -> DataFrame:
    """closed interval start <= column <= stop (wall clock).

    On a stored ``worklog`` (partitioned by ``month`` of ``date``) the same
    range is also stated on ``month``, so Spark prunes whole partitions
    before it opens a file.
    """
    out = df.where(F.col(column).between(_ts_lit(start), _ts_lit(stop)))
    if column == "date" and "month" in df.columns and not isinstance(start, Column) \
            and not isinstance(stop, Column):
        lo = _as_datetime(start).strftime("%Y-%m")
        hi = _as_datetime(stop).strftime("%Y-%m")
        out = out.where(F.col("month").between(F.lit(lo), F.lit(hi)))
    return out


def _as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    return dt.datetime.fromisoformat(str(value))


def non_resolved_issues(issue: DataFrame, min_age: str | None = None,
                        as_of: dt.datetime | None = None) -> DataFrame:
    """issues not resolved yet; ``min_age`` (e.g. "10 minutes") keeps only
    rows inserted at least that long before ``as_of`` (needs dateInserted)."""
    out = issue.where(~F.col("isResolved"))
    if min_age:
        now = X.utc_lit(as_of) if as_of else F.current_timestamp()
        out = out.where(F.col("dateInserted") <= now - F.expr(f"INTERVAL {min_age}"))
    return out


def done_status_issues(df: DataFrame, done_statuses: Iterable[str],
                       status_col: str = "status") -> DataFrame:
    """current status in the done list (case-insensitive); empty -> none."""
    return df.where(X.lower_in(status_col, list(done_statuses)))


def recent_weeks(worklog: DataFrame, as_of: dt.date, days: int = RECENT_WEEKS_DAYS,
                 column: str = "date") -> DataFrame:
    """F8: rows dated on or after midnight of ``as_of`` minus 35 days."""
    start = dt.datetime.combine(_as_date(as_of), dt.time()) - dt.timedelta(days=days)
    out = worklog.where(F.col(column) >= _ts_lit(start))
    if column == "date" and "month" in worklog.columns:
        out = out.where(F.col("month") >= F.lit(start.strftime("%Y-%m")))
    return out


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])
