"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver runs these over the same Parquet tables (views ``lineitem``,
``orders`` ...). Column names and types match the Spark results. DuckDB
differences handled here: ``CAST(x AS INTEGER)`` rounds (use ``trunc``),
``/`` on integers is a float division, ``week()`` is ISO.
"""

from __future__ import annotations

import datetime as dt

from hourbook.functions import ranges as R
from hourbook.operators import aggregates as A
from hourbook.plans import params as P
from hourbook.plans.params import sql_date, sql_ts

WORKLOG_CTE = """
worklog AS (
  SELECT
    l.l_orderkey * 10 + l.l_linenumber AS id,
    s.s_name AS author,
    l.l_shipdate AS date,
    CAST(week(l.l_shipdate) AS INTEGER) AS weekNumber,
    dayname(l.l_shipdate) AS weekDay,
    CAST(l.l_quantity * 600 AS INTEGER) AS timeSpentSeconds,
    round(CAST(CAST(l.l_quantity * 600 AS INTEGER) AS DOUBLE) / 3600.0 * 100) / 100 AS timeSpentHours,
    n.n_name AS project,
    l.l_orderkey AS issueId,
    concat_ws('-', n.n_name, CAST(l.l_orderkey AS VARCHAR)) AS issueKey,
    c.c_mktsegment AS issueType,
    'Order ' || CAST(l.l_orderkey AS VARCHAR) AS issueSummary,
    o.o_orderpriority AS issuePriority,
    o.o_orderstatus AS issueStatus,
    l.l_orderkey AS parentIssueId,
    concat_ws('-', n.n_name, CAST(l.l_orderkey AS VARCHAR)) AS parentIssueKey,
    c.c_mktsegment AS parentIssueType,
    'Order ' || CAST(l.l_orderkey AS VARCHAR) AS parentIssueSummary,
    o.o_orderpriority AS parentIssuePriority,
    o.o_orderstatus AS parentIssueStatus
  FROM lineitem l
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

ISSUE_CTE = """
lines_per_order AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, sum(l_quantity) AS qty,
         arg_max(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) AS last_suppkey
  FROM lineitem GROUP BY l_orderkey
),
issue AS (
  SELECT
    o.o_orderkey AS id,
    concat_ws('-', n.n_name, CAST(o.o_orderkey AS VARCHAR)) AS key,
    c.c_mktsegment AS type,
    'Order ' || CAST(o.o_orderkey AS VARCHAR) AS summary,
    o.o_orderpriority AS priority,
    o.o_orderstatus AS status,
    o.o_orderdate AS createDate,
    coalesce(lp.last_ship, o.o_orderdate) AS updateDate,
    CASE WHEN o.o_orderstatus = 'F' THEN coalesce(lp.last_ship, o.o_orderdate) END AS resolvedDate,
    o.o_orderstatus = 'F' AS isResolved,
    CASE WHEN o.o_orderstatus = 'F'
         THEN CAST(ceil((epoch_us(coalesce(lp.last_ship, o.o_orderdate)) - epoch_us(o.o_orderdate))
                        / 86400000000.0) AS INTEGER)
         ELSE 0 END AS daysToResolve,
    coalesce(CAST(trunc(lp.qty * 600) AS INTEGER), 0) AS aggregateTimeSpent,
    CAST(trunc(o.o_totalprice / 10) AS INTEGER) AS aggregateTimeOriginalEstimate,
    n.n_name AS project,
    s.s_name AS developer
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN lines_per_order lp ON lp.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON lp.last_suppkey = s.s_suppkey
)"""


def with_worklog(body: str) -> str:
    return f"WITH {WORKLOG_CTE}\n{body}"


def with_issue(body: str) -> str:
    return f"WITH {ISSUE_CTE}\n{body}"


def between(col: str, start: dt.datetime, stop: dt.datetime) -> str:
    return f"{col} BETWEEN {sql_ts(start)} AND {sql_ts(stop)}"


def hours_of_seconds(expr: str) -> str:
    return f"round(CAST(coalesce({expr}, 0) AS DOUBLE) / 3600.0 * 100) / 100"


def dec_sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


ISSUE_GROUP_COL = {"developer": "developer", "type": "type", "priority": "priority",
                   "project": "project", "status": "status"}
WORKLOG_GROUP_COL = {"type": "parentIssueType", "priority": "parentIssuePriority",
                     "project": "project", "weekday": "weekDay"}

WORKLOG_OUT = ("id, author, date, weekNumber, weekDay, timeSpentSeconds, timeSpentHours, "
               "project, issueId, issueKey, issueType, issueSummary, issuePriority, "
               "issueStatus, parentIssueId, parentIssueKey, parentIssueType, "
               "parentIssueSummary, parentIssuePriority, parentIssueStatus")
ISSUE_OUT = ("id, key, type, summary, priority, status, createDate, updateDate, "
             "resolvedDate, isResolved, daysToResolve, aggregateTimeSpent, "
             "aggregateTimeOriginalEstimate, project, developer")


def a1_sql(group: str, hours: str = "resolved") -> str:
    col = ISSUE_GROUP_COL[group]
    filt = " FILTER (WHERE isResolved)" if hours == "resolved" else ""
    return with_issue(f"""
SELECT {col} AS groupBy,
  count(*) FILTER (WHERE NOT isResolved) AS nonResolved,
  count(*) FILTER (WHERE isResolved) AS resolved,
  coalesce(CAST(trunc(avg(daysToResolve) FILTER (WHERE isResolved)) AS INTEGER), 0) AS daysToResolve,
  {hours_of_seconds(f"sum(aggregateTimeSpent){filt}")} AS timeSpent,
  {hours_of_seconds(f"sum(aggregateTimeOriginalEstimate){filt}")} AS timeEstimate
FROM issue
WHERE {between("updateDate", P.ALL_START, P.ALL_STOP)}
GROUP BY {col}""")


ACCURACY_EXPR = ("round((100.0 - abs((CAST(sum(aggregateTimeOriginalEstimate) AS DOUBLE)"
                 " - CAST(sum(aggregateTimeSpent) AS DOUBLE))"
                 " / CAST(sum(aggregateTimeOriginalEstimate) AS DOUBLE) * 100.0)) * 100) / 100")


def a2_body() -> str:
    return f"""
SELECT developer, count(*) AS count, {ACCURACY_EXPR} AS accuracy
FROM issue
WHERE {between("updateDate", P.ALL_START, P.ALL_STOP)}
  AND isResolved AND aggregateTimeOriginalEstimate > 0
GROUP BY developer"""


def a3_days(group: str, first: str, last: str) -> str:
    col = WORKLOG_GROUP_COL[group]
    return with_worklog(f"""
SELECT {col} AS groupBy, {dec_sum("timeSpentHours")} AS timeSpentHrs FROM worklog
WHERE CAST(date AS DATE) BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY {col}""")


def a3_sql(group: str, start=P.ALL_START, stop=P.ALL_STOP) -> str:
    col = WORKLOG_GROUP_COL[group]
    return with_worklog(f"""
SELECT {col} AS groupBy, {dec_sum("timeSpentHours")} AS timeSpentHrs
FROM worklog WHERE {between("date", start, stop)}
GROUP BY {col}""")


def a5_sql(start: dt.datetime, stop: dt.datetime, label: str = A.DAY_LABEL) -> str:
    n = max(0, int((stop - start).total_seconds() // 86400))
    days = [(start + dt.timedelta(days=i)).date() for i in range(n)]
    cells = [f"coalesce(sum(CAST(timeSpentHrs AS DECIMAL(18,2))) FILTER (WHERE day = {sql_date(d)}), 0)"
             for d in days]
    total = " + ".join(cells) if cells else "0.0"
    cols = [f"printf('%.2f', CAST({c} AS DOUBLE)) AS \"{d.strftime(label)}\""
            for c, d in zip(cells, days)]
    select = ",\n  ".join([f'developer AS " Developer"',
                           f"printf('%.2f', CAST({total} AS DOUBLE)) AS \" Total Hrs\""] + cols)
    return with_worklog(f"""
, a4 AS (
  SELECT author AS developer, CAST(date AS DATE) AS day,
         {dec_sum("timeSpentHours")} AS timeSpentHrs
  FROM worklog WHERE {between("date", start, stop)}
  GROUP BY author, CAST(date AS DATE))
SELECT {select}
FROM a4 GROUP BY developer""")


def a6_body(as_of: dt.datetime, weeks: int = 5) -> str:
    wk0 = R.iso_week_start(as_of)
    start = R.midnight(as_of) - dt.timedelta(days=7 * weeks)
    cols = ",\n  ".join(
        f"CAST(coalesce(sum(CAST(timeSpentHours AS DECIMAL(18,2))) FILTER (WHERE back = {k}), 0) AS DOUBLE) AS {name}"
        for k, name in enumerate(A.week_column_names(weeks)))
    return f"""
SELECT author AS Developer,
  {cols}
FROM (SELECT *, CAST(date_diff('day', CAST(date_trunc('week', date) AS DATE), {sql_date(wk0)}) // 7 AS INTEGER) AS back
      FROM worklog WHERE date >= {sql_ts(start)})
GROUP BY author"""


def avg_cents(col: str) -> str:
    """Mean of 2-place values, half away from zero, via integer cents."""
    c = f"CAST(round({col} * 100) AS BIGINT)"
    return (f"CASE WHEN count({col}) > 0 THEN sign(sum({c})) * "
            f"((2 * abs(sum({c})) + count({col})) // (2 * count({col}))) / 100.0 END")


def week_before(as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    ws = R.iso_week_start(as_of - dt.timedelta(days=7))
    return ws, ws + dt.timedelta(days=7)


def a8_sql(as_of: dt.datetime) -> str:
    ws, we = week_before(as_of)
    days = ", ".join(f"({i}, '{d}')" for i, d in enumerate(A.WEEKDAYS_SUNDAY_FIRST))
    return with_worklog(f"""
, d(i, day) AS (VALUES {days}),
w AS (SELECT weekDay, {dec_sum("timeSpentHours")} AS h FROM worklog
      WHERE date >= {sql_ts(ws)} AND date < {sql_ts(we)} GROUP BY weekDay)
SELECT d.day AS day, coalesce(w.h, 0.0) AS timeSpentHrs
FROM d LEFT JOIN w ON w.weekDay = d.day""")


def a9_sql(as_of: dt.datetime) -> str:
    ws, we = week_before(as_of)
    cols = ",\n  ".join(
        f"CAST(coalesce(sum(CAST(timeSpentHours AS DECIMAL(18,2))) FILTER (WHERE weekDay = '{d}'), 0) AS DOUBLE) AS {d}"
        for d in A.WORKDAYS)
    return with_worklog(f"""
SELECT author AS Developer,
  {cols}
FROM worklog WHERE date >= {sql_ts(ws)} AND date < {sql_ts(we)}
GROUP BY author""")


def j4_sql(start: dt.datetime, stop: dt.datetime) -> str:
    last = stop - dt.timedelta(days=1)
    return with_worklog(f"""
, a4 AS (
  SELECT author AS developer, CAST(date AS DATE) AS day,
         {dec_sum("timeSpentHours")} AS timeSpentHrs
  FROM worklog WHERE {between("date", start, stop)}
  GROUP BY author, CAST(date AS DATE)),
grid AS (
  SELECT developer, CAST(g.day AS DATE) AS day
  FROM (SELECT DISTINCT author AS developer FROM worklog) dv,
       generate_series({sql_ts(start)}, {sql_ts(last)}, INTERVAL 1 DAY) AS g(day))
SELECT grid.developer, grid.day, CAST(coalesce(a4.timeSpentHrs, 0) AS DOUBLE) AS timeSpentHrs
FROM grid LEFT JOIN a4 ON a4.developer IS NOT DISTINCT FROM grid.developer AND a4.day = grid.day""")


def extra_sql() -> dict[str, str]:
    """R1-R5."""
    as_of, ny = P.AS_OF, P.AS_OF_NEW_YEAR
    limit = R.midnight(as_of) - dt.timedelta(days=P.OPEN_OLDER_THAN_DAYS)
    wk0 = R.iso_week_start(ny)
    r2_start, r2_stop = wk0 - dt.timedelta(weeks=5), wk0 + dt.timedelta(weeks=1)
    recent = R.midnight(ny) - dt.timedelta(days=35)
    recent6 = R.midnight(ny) - dt.timedelta(days=42)
    weekly = lambda since: f"""
  SELECT author AS developer, CAST(date_trunc('week', date) AS DATE) AS week,
         sum(CAST(round(timeSpentHours * 100) AS BIGINT)) AS c
  FROM worklog WHERE date >= {sql_ts(since)} AND date < {sql_ts(wk0 + dt.timedelta(weeks=1))}
  GROUP BY author, CAST(date_trunc('week', date) AS DATE)"""
    return {
        "open_issues_older_than": with_issue(f"""
SELECT id, key, type, status, developer, createDate,
       CAST(date_diff('day', CAST(createDate AS DATE), {sql_date(as_of)}) AS INTEGER) AS ageDays
FROM issue WHERE NOT isResolved AND createDate < {sql_ts(limit)}"""),
        "resolve_days_trend": with_issue(f"""
SELECT type, CAST(date_trunc('week', resolvedDate) AS DATE) AS week,
       count(*) AS resolved,
       CAST(trunc(avg(daysToResolve)) AS INTEGER) AS daysToResolve
FROM issue WHERE isResolved AND resolvedDate >= {sql_ts(r2_start)} AND resolvedDate < {sql_ts(r2_stop)}
GROUP BY type, CAST(date_trunc('week', resolvedDate) AS DATE)"""),
        "developers_without_hours": with_worklog(f"""
, a4 AS (
  SELECT author AS developer, CAST(date AS DATE) AS day, sum(timeSpentHours) AS h
  FROM worklog WHERE {between("date", P.SHEET_START, P.SHEET_STOP)}
  GROUP BY author, CAST(date AS DATE)),
grid AS (
  SELECT developer, CAST(g.day AS DATE) AS day
  FROM (SELECT DISTINCT author AS developer FROM worklog) dv,
       generate_series({sql_ts(P.SHEET_START)}, {sql_ts(P.SHEET_STOP - dt.timedelta(days=1))},
                       INTERVAL 1 DAY) AS g(day))
SELECT developer, day FROM grid
WHERE NOT EXISTS (SELECT 1 FROM a4 WHERE a4.developer IS NOT DISTINCT FROM grid.developer
                  AND a4.day = grid.day AND a4.h > 0)"""),
        "workweek_percent": with_worklog(f"""
, wk AS ({weekly(recent)}),
p AS (SELECT developer, week, c / 100.0 AS hours,
             round(c / 100.0 / 40.0 * 100.0 * 100) / 100 AS percent FROM wk)
SELECT developer, week, hours, percent,
       CASE WHEN percent < 40.0 THEN 'under 40%' WHEN percent < 60.0 THEN '40-60%'
            ELSE '60% and more' END AS band
FROM p"""),
        "week_over_week_change": with_worklog(f"""
, wk AS ({weekly(recent6)}),
weeks AS (
  SELECT developer, CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP), {sql_ts(R.iso_week_start(ny))},
                                                INTERVAL 7 DAY)) AS DATE) AS week FROM wk GROUP BY developer),
filled AS (
  SELECT weeks.developer, weeks.week, coalesce(wk.c, 0) AS c FROM weeks LEFT JOIN wk
  ON wk.developer IS NOT DISTINCT FROM weeks.developer AND wk.week = weeks.week)
SELECT developer, week, c / 100.0 AS hours,
       (c - lag(c) OVER (PARTITION BY developer ORDER BY week)) / 100.0 AS change
FROM filled"""),
    }


def report_sql() -> dict[str, str]:
    s_last_month, e_last_month = R.preset_range("last_month", P.AS_OF)
    s_api, e_api = R.api_range(as_of=P.AS_OF)
    out = {
        "scan_worklogs": with_worklog(f"SELECT {WORKLOG_OUT} FROM worklog"),
        "scan_issues": with_issue(f"SELECT {ISSUE_OUT} FROM issue"),
        "in_date_range": with_worklog(
            f"SELECT id, author, date, timeSpentHours FROM worklog "
            f"WHERE {between('date', P.SHEET_START, P.SHEET_STOP)}"),
        "non_resolved_issues": with_issue(
            "SELECT id, key, status, createDate, updateDate, developer FROM issue WHERE NOT isResolved"),
        "done_status_issues": with_issue(
            "SELECT id, key, status FROM issue WHERE lower(status) IN ('f')"),
        "filter_users": with_worklog(
            "SELECT id, author, timeSpentHours FROM worklog WHERE lower(author) IN "
            "('supplier#000000001', 'supplier#000000002', 'supplier#000000003')"),
        "recent_weeks": with_worklog(
            f"SELECT id, author, date FROM worklog WHERE date >= "
            f"{sql_ts(R.midnight(P.AS_OF_NEW_YEAR) - dt.timedelta(days=35))}"),
        "preset_range": a3_sql("type", s_last_month, e_last_month),
        # days written out, not computed by the functions they check; as_of is Wednesday, 8 January 1997
        "preset_range_yesterday": a3_days("type", "1997-01-07", "1997-01-07"),
        "preset_range_this_week": a3_days("type", "1997-01-06", "1997-01-12"),
        "preset_range_last_week": a3_days("type", "1996-12-30", "1997-01-05"),
        "preset_range_this_month": a3_days("type", "1997-01-01", "1997-01-31"),
        "explicit_range": with_worklog(f"""
SELECT parentIssueType AS groupBy, {dec_sum("timeSpentHours")} AS timeSpentHrs FROM worklog
WHERE date BETWEEN TIMESTAMP '1996-12-30 00:00:00' AND TIMESTAMP '1997-01-06 00:00:00' GROUP BY parentIssueType"""),
        "filter_users_table": with_worklog(
            ", names AS (SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey "
            f"WHERE n_name = '{P.USERS_OF_NATION}') SELECT id, author, timeSpentHours FROM worklog "
            "WHERE author IN (SELECT s_name FROM names) OR (SELECT count(*) FROM names) = 0"),
        "non_resolved_issues_min_age": with_issue(
            "SELECT id, key FROM issue WHERE NOT isResolved AND createDate <= TIMESTAMP '1996-12-09 00:00:00'"),
        "issue_accuracy_unestimated": with_issue(f"""
SELECT developer, count(*) AS count, {ACCURACY_EXPR} AS accuracy FROM issue
WHERE {between("updateDate", P.ALL_START, P.ALL_STOP)} AND isResolved GROUP BY developer"""),
        "api_default_range": a3_sql("weekday", s_api, e_api),
        "issue_accuracy": with_issue(a2_body()),
        "issue_accuracy_with_average": with_issue(f"""
, a AS ({a2_body()})
SELECT developer, count, accuracy FROM a
UNION ALL
SELECT 'Average' AS developer, CAST(NULL AS BIGINT) AS count,
       {avg_cents("accuracy")} AS accuracy FROM a"""),
        "overall_accuracy": with_issue(f"""
SELECT count(*) AS count, {ACCURACY_EXPR} AS accuracy
FROM issue
WHERE {between("updateDate", P.ALL_START, P.ALL_STOP)}
  AND isResolved AND aggregateTimeOriginalEstimate > 0"""),
        "worklogs_per_dev_day": with_worklog(f"""
SELECT author AS developer, CAST(date AS DATE) AS day, {dec_sum("timeSpentHours")} AS timeSpentHrs
FROM worklog WHERE {between("date", P.ALL_START, P.ALL_STOP)}
GROUP BY author, CAST(date AS DATE)"""),
        "developer_day_grid": j4_sql(P.GRID_START, P.GRID_STOP),
        "worklogs_per_dev": a5_sql(P.SHEET_START, P.SHEET_STOP),
        "worklogs_per_dev_two_years": a5_sql(P.SHEET_START, P.SHEET_TWO_YEARS, "%Y-%m-%d"),
        "worklogs_per_dev_same_day": a5_sql(P.SHEET_STOP, P.SHEET_STOP),
        "worklogs_per_dev_week": with_worklog(a6_body(P.AS_OF_NEW_YEAR)),
        "worklogs_per_dev_week_with_average": with_worklog(f"""
, a AS ({a6_body(P.AS_OF_NEW_YEAR)})
SELECT * FROM a
UNION ALL
SELECT 'Average' AS Developer,
  {", ".join(f"{avg_cents(c)} AS {c}" for c in A.WEEK_COLUMNS)}
FROM a"""),
        "hours_per_week_pivot": with_worklog(a6_body(P.AS_OF_NEW_YEAR, weeks=6)),
        "worklogs_per_weekday": a8_sql(P.AS_OF),
        "worklogs_per_dev_weekday": a9_sql(P.AS_OF),
        "sort_report": with_issue(a2_body() + "\nORDER BY developer NULLS FIRST"),
    }
    out.update(extra_sql())
    for g in ISSUE_GROUP_COL:
        out[f"issues_grouped_by_{g}"] = a1_sql(g)
    out["issues_grouped_by_priority_all_hours"] = a1_sql("priority", hours="all")
    for g in WORKLOG_GROUP_COL:
        out[f"worklogs_group_by_{g}"] = a3_sql(g)
    out["write_report"] = a3_sql("priority")
    return out
