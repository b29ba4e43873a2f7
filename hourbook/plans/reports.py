"""Report plans over the bound ``worklog`` / ``issue`` tables.

Each function takes (spark, sf_dir) and returns the report DataFrame; the
registry in ``__spark_entry__`` exposes them under the operator names of
the blueprint.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourbook.functions import ranges as R
from hourbook.operators import aggregates as A
from hourbook.operators import filters as FL
from hourbook.operators.projections import validate_issue_group, validate_worklog_group
from hourbook.plans import params as P
from hourbook.sources.binding import bound_issue, bound_worklog
from hourbook.sources.tables import read_table, scan_issues, scan_worklogs


# Columns each report reads; the binding joins only what they need.
ISSUE_A1 = ("updateDate", "isResolved", "daysToResolve", "aggregateTimeSpent",
            "aggregateTimeOriginalEstimate")
ISSUE_A2 = ("updateDate", "isResolved", "aggregateTimeSpent",
            "aggregateTimeOriginalEstimate", "developer")
WL_HOURS = ("date", "timeSpentHours")
WL_DEV = ("author", "date", "timeSpentHours")
WL_WEEKDAY = ("author", "date", "weekDay", "timeSpentHours")
WL_DAYS = ("date", "weekDay", "timeSpentHours")


def _wl(spark, sf_dir, cols):
    return bound_worklog(spark, sf_dir, columns=cols)


def _is(spark, sf_dir, cols):
    return bound_issue(spark, sf_dir, columns=cols)


# --- scans (S4, S5) ------------------------------------------------------------
def q_scan_worklogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_worklogs(bound_worklog(spark, sf_dir)).drop("started_at")


def q_scan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_issues(bound_issue(spark, sf_dir)).drop("created_at")


# --- filters ---------------------------------------------------------------------
def q_in_date_range(spark, sf_dir):
    """F4 on worklog.date: the week of the timesheet (closed interval)."""
    wl = _wl(spark, sf_dir, ("id", "author", "date", "timeSpentHours"))
    return FL.in_date_range(wl, "date", P.SHEET_START, P.SHEET_STOP).select(
        "id", "author", "date", "timeSpentHours")


def q_non_resolved_issues(spark, sf_dir):
    cols = ("id", "key", "status", "createDate", "updateDate", "developer", "isResolved")
    return FL.non_resolved_issues(_is(spark, sf_dir, cols)).select(
        "id", "key", "status", "createDate", "updateDate", "developer")


def q_done_status_issues(spark, sf_dir):
    return FL.done_status_issues(_is(spark, sf_dir, ("id", "key", "status")), ["f"]).select(
        "id", "key", "status")


def q_filter_users(spark, sf_dir):
    """F3 with a mixed-case user list (case-insensitive match)."""
    users = ["supplier#000000001", "SUPPLIER#000000002", "Supplier#000000003"]
    wl = _wl(spark, sf_dir, ("id", "author", "timeSpentHours"))
    return FL.filter_users(wl, users).select(
        "id", "author", "timeSpentHours")


def q_filter_users_table(spark, sf_dir):
    """F3 with a table of names: the suppliers of one nation, in capitals."""
    supplier, nation = (read_table(spark, sf_dir, t) for t in ("supplier", "nation"))
    own = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).where(F.col("n_name") == P.USERS_OF_NATION)
    wl = _wl(spark, sf_dir, ("id", "author", "timeSpentHours"))
    return FL.filter_users(wl, own.select(F.upper("s_name").alias("name"))).select("id", "author", "timeSpentHours")


def q_non_resolved_issues_min_age(spark, sf_dir):
    """F5 with ``min_age``: created (taken as inserted) at least 30 days ago."""
    issues = _is(spark, sf_dir, ("id", "key", "isResolved", "createDate"))
    aged = issues.withColumn("dateInserted", F.col("createDate").cast("timestamp"))
    return FL.non_resolved_issues(aged, min_age="30 days", as_of=P.AS_OF).select("id", "key")


def _preset(name):
    def query(spark, sf_dir):
        start, stop = R.preset_range(name, P.AS_OF)
        return A.worklogs_group_by(_wl(spark, sf_dir, ("date", "parentIssueType", "timeSpentHours")), "type", start, stop)
    query.__doc__ = f"F9: hours by type, {name.replace('_', ' ')}."
    return query


def q_explicit_range(spark, sf_dir):
    """F9 with a first day only: one week from it."""
    start, stop = R.explicit_range(P.EXPLICIT_START, None, P.AS_OF)
    return A.worklogs_group_by(_wl(spark, sf_dir, ("date", "parentIssueType", "timeSpentHours")), "type", start, stop)


def q_issue_accuracy_unestimated(spark, sf_dir):
    """A2 with issues that have no estimate."""
    cols = ("updateDate", "isResolved", "aggregateTimeOriginalEstimate", "aggregateTimeSpent", "developer")
    return A.issue_accuracy(_is(spark, sf_dir, cols), P.ALL_START, P.ALL_STOP, include_unestimated=True)


def q_recent_weeks(spark, sf_dir):
    return FL.recent_weeks(_wl(spark, sf_dir, ("id", "author", "date")), P.AS_OF_NEW_YEAR).select(
        "id", "author", "date")


def q_preset_range(spark, sf_dir):
    """F9 'last_month' preset feeding F4, then A3 by type."""
    s, e = R.preset_range("last_month", P.AS_OF)
    cols = WL_HOURS + (validate_worklog_group("type"),)
    return A.worklogs_group_by(_wl(spark, sf_dir, cols), "type", s, e)


def q_api_default_range(spark, sf_dir):
    """F10 default range (midnight 7 days ago + 8 days) feeding A3 by weekday."""
    s, e = R.api_range(as_of=P.AS_OF)
    cols = WL_HOURS + (validate_worklog_group("weekday"),)
    return A.worklogs_group_by(_wl(spark, sf_dir, cols), "weekday", s, e)


# --- A1 ------------------------------------------------------------------------------
def _a1(group: str, hours: str = "resolved"):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = ISSUE_A1 + (validate_issue_group(group),)
        return A.issues_grouped_by(_is(spark, sf_dir, cols), group,
                                   P.ALL_START, P.ALL_STOP, hours=hours)
    q.__name__ = f"issues_grouped_by_{group}"
    return q


# --- A2, A7, R6 -------------------------------------------------------------------------
def q_issue_accuracy(spark, sf_dir):
    return A.issue_accuracy(_is(spark, sf_dir, ISSUE_A2), P.ALL_START, P.ALL_STOP)


def q_issue_accuracy_with_average(spark, sf_dir):
    acc = A.issue_accuracy(_is(spark, sf_dir, ISSUE_A2), P.ALL_START, P.ALL_STOP)
    return A.with_average_row(acc, ["accuracy"], "developer")


def q_overall_accuracy(spark, sf_dir):
    return A.overall_accuracy(_is(spark, sf_dir, ISSUE_A2), P.ALL_START, P.ALL_STOP)


# --- A3 --------------------------------------------------------------------------------
def _a3(group: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = WL_HOURS + (validate_worklog_group(group),)
        return A.worklogs_group_by(_wl(spark, sf_dir, cols), group,
                                   P.ALL_START, P.ALL_STOP)
    q.__name__ = f"worklogs_group_by_{group}"
    return q


# --- A4, J4, A5 --------------------------------------------------------------------------
def q_worklogs_per_dev_day(spark, sf_dir):
    return A.worklogs_per_dev_day(_wl(spark, sf_dir, WL_DEV), P.ALL_START, P.ALL_STOP)


def q_developer_day_grid(spark, sf_dir):
    return A.developer_day_grid(_wl(spark, sf_dir, WL_DEV), P.GRID_START, P.GRID_STOP)


def q_worklogs_per_dev(spark, sf_dir):
    return A.worklogs_per_dev(_wl(spark, sf_dir, WL_DEV), P.SHEET_START, P.SHEET_STOP)


def q_worklogs_per_dev_two_years(spark, sf_dir):
    return A.worklogs_per_dev(_wl(spark, sf_dir, WL_DEV), P.SHEET_START, P.SHEET_TWO_YEARS, "%Y-%m-%d")


def q_worklogs_per_dev_same_day(spark, sf_dir):
    """A5 with start = stop: no day columns, total 0.00."""
    return A.worklogs_per_dev(_wl(spark, sf_dir, WL_DEV), P.SHEET_STOP, P.SHEET_STOP)


# --- A6, A7, R7 ------------------------------------------------------------------------------
def q_worklogs_per_dev_week(spark, sf_dir):
    return A.worklogs_per_dev_week(_wl(spark, sf_dir, WL_DEV), P.AS_OF_NEW_YEAR)


def q_worklogs_per_dev_week_with_average(spark, sf_dir):
    weekly = A.worklogs_per_dev_week(_wl(spark, sf_dir, WL_DEV), P.AS_OF_NEW_YEAR)
    return A.with_average_row(weekly, list(A.WEEK_COLUMNS), "Developer")


def q_hours_per_week_pivot(spark, sf_dir):
    return A.hours_per_week_pivot(_wl(spark, sf_dir, WL_DEV), P.AS_OF_NEW_YEAR)


# --- A8, A9 --------------------------------------------------------------------------------------
def q_worklogs_per_weekday(spark, sf_dir):
    return A.worklogs_per_weekday(_wl(spark, sf_dir, WL_DAYS), P.AS_OF)


def q_worklogs_per_dev_weekday(spark, sf_dir):
    return A.worklogs_per_dev_weekday(_wl(spark, sf_dir, WL_WEEKDAY), P.AS_OF)


# --- O1 ----------------------------------------------------------------------------------------------
def q_sort_report(spark, sf_dir):
    acc = A.issue_accuracy(_is(spark, sf_dir, ISSUE_A2), P.ALL_START, P.ALL_STOP)
    return A.sort_report(acc)


# --- R1-R5 ------------------------------------------------------------------------------
def q_open_issues_older_than(spark, sf_dir):
    cols = ("id", "key", "type", "status", "developer", "createDate", "isResolved")
    return A.open_issues_older_than(_is(spark, sf_dir, cols), P.AS_OF, P.OPEN_OLDER_THAN_DAYS)


def q_resolve_days_trend(spark, sf_dir):
    cols = ("type", "isResolved", "resolvedDate", "daysToResolve")
    return A.resolve_days_trend(_is(spark, sf_dir, cols), P.AS_OF_NEW_YEAR)


def q_developers_without_hours(spark, sf_dir):
    return A.developers_without_hours(_wl(spark, sf_dir, WL_DEV), P.SHEET_START, P.SHEET_STOP)


def q_workweek_percent(spark, sf_dir):
    return A.workweek_percent(_wl(spark, sf_dir, WL_DEV), P.AS_OF_NEW_YEAR)


def q_week_over_week_change(spark, sf_dir):
    return A.week_over_week_change(_wl(spark, sf_dir, WL_DEV), P.AS_OF_NEW_YEAR)


# --- K5 ---------------------------------------------------------------------------------
def q_write_report(spark, sf_dir):
    """K5: the A3 priority report written as JSON lines and read back."""
    import os
    import uuid
    from hourbook.session import checkpoint_dir
    from hourbook.sources.store import write_report
    rep = _a3("priority")(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"hourbook-report-{uuid.uuid4().hex[:12]}")
    write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)


REPORT_QUERIES = {
    "scan_worklogs": q_scan_worklogs,
    "scan_issues": q_scan_issues,
    "in_date_range": q_in_date_range,
    "non_resolved_issues": q_non_resolved_issues,
    "done_status_issues": q_done_status_issues,
    "filter_users": q_filter_users,
    "recent_weeks": q_recent_weeks,
    "preset_range": q_preset_range,
    **{f"preset_range_{name}": _preset(name) for name in ("yesterday", "this_week", "last_week", "this_month")},
    "explicit_range": q_explicit_range,
    "filter_users_table": q_filter_users_table,
    "non_resolved_issues_min_age": q_non_resolved_issues_min_age,
    "issue_accuracy_unestimated": q_issue_accuracy_unestimated,
    "api_default_range": q_api_default_range,
    "issues_grouped_by_developer": _a1("developer"),
    "issues_grouped_by_type": _a1("type"),
    "issues_grouped_by_priority": _a1("priority"),
    "issues_grouped_by_project": _a1("project"),
    "issues_grouped_by_status": _a1("status"),
    "issues_grouped_by_priority_all_hours": _a1("priority", hours="all"),
    "issue_accuracy": q_issue_accuracy,
    "issue_accuracy_with_average": q_issue_accuracy_with_average,
    "worklogs_group_by_priority": _a3("priority"),
    "worklogs_group_by_type": _a3("type"),
    "worklogs_group_by_project": _a3("project"),
    "worklogs_group_by_weekday": _a3("weekday"),
    "worklogs_per_dev_day": q_worklogs_per_dev_day,
    "developer_day_grid": q_developer_day_grid,
    "worklogs_per_dev": q_worklogs_per_dev,
    "worklogs_per_dev_two_years": q_worklogs_per_dev_two_years,
    "worklogs_per_dev_same_day": q_worklogs_per_dev_same_day,
    "worklogs_per_dev_week": q_worklogs_per_dev_week,
    "worklogs_per_dev_week_with_average": q_worklogs_per_dev_week_with_average,
    "worklogs_per_weekday": q_worklogs_per_weekday,
    "worklogs_per_dev_weekday": q_worklogs_per_dev_weekday,
    "sort_report": q_sort_report,
    "overall_accuracy": q_overall_accuracy,
    "hours_per_week_pivot": q_hours_per_week_pivot,
    "open_issues_older_than": q_open_issues_older_than,
    "resolve_days_trend": q_resolve_days_trend,
    "developers_without_hours": q_developers_without_hours,
    "workweek_percent": q_workweek_percent,
    "week_over_week_change": q_week_over_week_change,
    "write_report": q_write_report,
}

