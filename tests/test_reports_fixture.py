"""Reports A1-A9 on the canonical fixture rows and plain Python,
plus invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourbook.functions.schemas import ISSUE, WORKLOG
from hourbook.operators import aggregates as A

T0 = dt.datetime(2021, 2, 10, 12, 0)
START, STOP = dt.datetime(2021, 2, 8), dt.datetime(2021, 2, 16)

# id, priority, type, developer, status, spent s, estimate s, days, resolved
ISSUES = [
    (21, "Major", "Bug", "ana.ruiz", "Done", 5400, 3600, 5, True),
    (22, "Major", "Bug", "ana.ruiz", "Review", 900, 0, 0, False),
    (23, "Minor", "Epic", "ana.ruiz", "Done", 9000, 10800, 2, True),
    (24, "Minor", "Task", "ben.okoye", "Done", 2700, 2700, 4, True),
    (25, "Trivial", "Task", "ben.okoye", "Backlog", 0, 7200, 0, False),
    (26, "Blocker", "Bug", "ben.okoye", "Review", 4500, 3600, 0, False),
    (27, "Trivial", "Task", "cleo", "Done", 1800, 5400, 9, True),
]
COLUMN = {"priority": 1, "type": 2, "developer": 3, "status": 4}


@pytest.fixture(scope="module")
def issue(spark):
    rows = []
    for (i, pr, ty, dev, st, sp, es, days, res) in ISSUES:
        created = T0 - dt.timedelta(hours=36)
        rows.append((i, f"OPS-{i}", ty, "s", pr, st, created, None, T0,
                     T0 - dt.timedelta(hours=2) if res else None, res, days, sp, es, "OPS", dev))
    df = spark.createDataFrame(rows, ISSUE)
    return df


def grouped(key):
    """The report by plain Python."""
    out = {}
    for row in ISSUES:
        out.setdefault("OPS" if key == "project" else row[COLUMN[key]], []).append(row)
    return out


@pytest.mark.parametrize("key", ["developer", "type", "priority", "project", "status"])
def test_issues_grouped_by(spark, issue, key):
    res = {r.groupBy: r for r in A.issues_grouped_by(issue, key, START, STOP).collect()}
    alls = {r.groupBy: r for r in A.issues_grouped_by(issue, key.upper(), START, STOP,
                                                       hours="all").collect()}
    want = grouped(key)
    assert set(res) == set(alls) == set(want)
    for g, rows in want.items():
        done = [r for r in rows if r[8]]
        days = sum(r[7] for r in done) // len(done) if done else 0
        hours = [round(sum(r[i] for r in x) / 3600, 2) for x in (done, rows) for i in (5, 6)]
        r, a = res[g], alls[g]
        assert (r.nonResolved, r.resolved, r.daysToResolve) == (len(rows) - len(done), len(done), days)
        assert [r.timeSpent, r.timeEstimate, a.timeSpent, a.timeEstimate] == hours
    assert dict(A.issues_grouped_by(issue, "type", START, STOP).dtypes)["resolved"] == "bigint"


def test_group_report_by_hand(spark, issue):
    got = {r.groupBy: tuple(r)[1:] for r in A.issues_grouped_by(issue, "type", START, STOP).collect()}
    assert got == {"Bug": (2, 1, 5, 1.5, 1.0), "Epic": (0, 1, 2, 2.5, 3.0), "Task": (1, 2, 6, 1.25, 2.25)}


def test_unknown_keys(spark, issue):
    with pytest.raises(ValueError, match="colour.*developer, type"):
        A.issues_grouped_by(issue, "colour", START, STOP)
    with pytest.raises(ValueError, match="weekday"):
        A.worklogs_group_by(issue, "developer", START, STOP)


def test_range_excludes(spark, issue):
    assert A.issues_grouped_by(issue, "project", START, T0 - dt.timedelta(seconds=1)).count() == 0


def test_issue_accuracy_and_footer(spark, issue):
    acc = {r.developer: (r["count"], r.accuracy) for r in A.issue_accuracy(issue, START, STOP).collect()}
    # ana: 14400 s estimated and spent; ben: 2700 and 2700; cleo: 5400 and 1800
    assert acc == {"ana.ruiz": (2, 100.0), "ben.okoye": (1, 100.0), "cleo": (1, 33.33)}
    foot = A.with_average_row(A.issue_accuracy(issue, START, STOP), ["accuracy"], "developer")
    avg = foot.where("developer = 'Average'").first()
    assert avg.accuracy == 77.78 and avg["count"] is None
    # 22500 s estimated, 18900 s spent
    assert A.overall_accuracy(issue, START, STOP).first().accuracy == 84.0


def test_accuracy_zero_estimate(spark, issue):
    z = issue.withColumn("aggregateTimeOriginalEstimate", F.lit(0))
    assert A.issue_accuracy(z, START, STOP).count() == 0                 # SQL semantics
    inc = A.issue_accuracy(z, START, STOP, include_unestimated=True).collect()
    assert {r.developer: r.accuracy for r in inc} == {"ana.ruiz": None, "ben.okoye": None, "cleo": None}


# --- worklog reports ---------------------------------------------------------------------
def wl_row(i, author, date, seconds, prio="High", typ="story", proj="OPS"):
    hours = round(seconds / 3600 * 100) / 100
    return (i, author, date, None, date.isocalendar()[1], date.strftime("%A"), seconds, hours,
            proj, 100 + i, f"{proj}-{i}", typ, "s", prio, "Open", 100 + i, f"{proj}-{i}", typ, "s",
            prio, "Open")


@pytest.fixture(scope="module")
def worklog(spark):
    d = dt.datetime
    rows = [
        wl_row(10, "ben.okoye", d(2021, 2, 8), 3600),
        wl_row(11, "ben.okoye", d(2021, 2, 8, 15), 1800, prio="Low", typ="bug"),
        wl_row(12, "ana.ruiz", d(2021, 2, 9), 2500, proj="LAB"),
        wl_row(13, "ana.ruiz", d(2021, 2, 13), 3300, proj="LAB"),          # Saturday
        wl_row(14, "cleo", d(2021, 2, 16), 3600),                           # exactly at stop
        wl_row(15, "ben.okoye", d(2021, 1, 20), 7200),                      # 3 weeks back
        wl_row(16, "dan", d(2021, 2, 13), 3600),                            # weekend only
    ]
    return spark.createDataFrame(rows, WORKLOG)


def test_worklogs_group_by(spark, worklog):
    by = {r.groupBy: r.timeSpentHrs for r in A.worklogs_group_by(worklog, "priority", START, STOP).collect()}
    assert by == {"High": 4.61, "Low": 0.5}       # exact decimal sum, not float addition
    total = sum(r.timeSpentHours for r in worklog.collect() if START <= r.date <= STOP)
    for key in ("type", "priority", "project", "weekday"):
        s = sum(r.timeSpentHrs for r in A.worklogs_group_by(worklog, key, START, STOP).collect())
        assert abs(s - total) < 1e-9


def test_worklogs_per_dev(spark, worklog):
    wide = A.worklogs_per_dev(worklog, START, STOP)
    cols = wide.columns
    assert cols[:2] == [A.DEVELOPER_COL, A.TOTAL_COL]
    assert cols[2:] == ["Feb 08", "Feb 09", "Feb 10", "Feb 11", "Feb 12", "Feb 13", "Feb 14", "Feb 15"]
    rows = {r[A.DEVELOPER_COL]: r for r in wide.collect()}
    assert rows["ben.okoye"]["Feb 08"] == "1.50" and rows["ben.okoye"][A.TOTAL_COL] == "1.50"
    assert rows["ana.ruiz"][A.TOTAL_COL] == "1.61"
    assert rows["cleo"][A.TOTAL_COL] == "0.00"          # D10: hours at stop show nowhere
    for r in rows.values():
        assert abs(sum(float(r[c]) for c in cols[2:]) - float(r[A.TOTAL_COL])) < 1e-9
    same = A.worklogs_per_dev(worklog, START, START).collect()
    assert [tuple(r) for r in same] == [("ben.okoye", "0.00")]
    with pytest.raises(ValueError):
        A.worklogs_per_dev(worklog, dt.datetime(2019, 1, 1), STOP)


def test_developer_day_grid(spark, worklog):
    grid = A.developer_day_grid(worklog, START, STOP)
    assert grid.count() == 4 * 8        # ben, ana, cleo, dan x 8 days
    assert grid.where("developer = 'cleo'").agg(F.sum("timeSpentHrs")).first()[0] == 0.0


def test_worklogs_per_dev_week(spark, worklog):
    rows = {r.Developer: r for r in A.worklogs_per_dev_week(worklog, dt.date(2021, 2, 10)).collect()}
    assert rows["ben.okoye"].ThisWeek == 1.5 and rows["ben.okoye"].ThreeWeeks == 2.0
    assert rows["ana.ruiz"].ThisWeek == 1.61
    assert rows["cleo"].ThisWeek == 0.0               # next week's row: zero row, developer kept
    wide = A.hours_per_week_pivot(worklog, dt.date(2021, 2, 10), weeks=6)
    assert wide.columns[-1] == "Weeks5"


def test_week_buckets_across_new_year(spark):
    d = dt.datetime
    df = spark.createDataFrame([wl_row(1, "a", d(2020, 12, 30), 3600),
                                wl_row(2, "a", d(2021, 1, 4), 1800)], WORKLOG)
    r = A.worklogs_per_dev_week(df, dt.date(2021, 1, 6)).first()
    assert (r.ThisWeek, r.LastWeek) == (0.5, 1.0)


def test_weekday_reports(spark, worklog):
    per_day = A.worklogs_per_weekday(worklog, dt.date(2021, 2, 17)).collect()
    assert [r.day for r in per_day] == list(A.WEEKDAYS_SUNDAY_FIRST)
    got = {r.day: r.timeSpentHrs for r in per_day}
    assert got["Monday"] == 1.5 and got["Saturday"] == 1.92 and got["Sunday"] == 0.0
    dev = {r.Developer: r for r in A.worklogs_per_dev_weekday(worklog, dt.date(2021, 2, 17)).collect()}
    assert dev["dan"].Monday == 0.0 and "Saturday" not in dev["dan"].asDict()
    assert dev["ana.ruiz"].Tuesday == 0.69


def test_sort_report(spark, issue):
    out = A.sort_report(A.issue_accuracy(issue, START, STOP)).collect()
    assert [r.developer for r in out] == ["ana.ruiz", "ben.okoye", "cleo"]


def test_long_timesheet_labels(spark, worklog):
    with pytest.raises(ValueError, match="same label"):
        A.worklogs_per_dev(worklog, dt.datetime(2019, 2, 15), dt.datetime(2021, 2, 15))
    wide = A.worklogs_per_dev(worklog, dt.datetime(2019, 2, 15), dt.datetime(2021, 2, 15), "%Y-%m-%d")
    cols = wide.columns[2:]
    assert len(cols) == 731 and cols[0] == "2019-02-15" and cols[-1] == "2021-02-14"
    rows = {r[A.DEVELOPER_COL]: r for r in wide.collect()}
    assert rows["ben.okoye"]["2021-02-08"] == "1.50" and rows["ben.okoye"]["2021-01-20"] == "2.00"


def test_developers_without_hours_lists_everyone(spark, worklog):
    """Also developers whose only rows lie outside the range."""
    rows = A.developers_without_hours(worklog, dt.datetime(2021, 1, 18), dt.datetime(2021, 1, 21)).collect()
    days = [dt.date(2021, 1, d) for d in (18, 19, 20)]
    want = {(p, d) for p in ("ana.ruiz", "ben.okoye", "cleo", "dan") for d in days} - {("ben.okoye", days[2])}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_week_over_week_fills_empty_weeks(spark):
    """A week without hours counts as 0."""
    d = dt.datetime
    df = spark.createDataFrame([wl_row(1, "a", d(2021, 1, 5), 7200), wl_row(2, "a", d(2021, 1, 20), 3600)], WORKLOG)
    got = {r.week: (r.hours, r.change) for r in A.week_over_week_change(df, d(2021, 1, 27)).collect()}
    assert got == {dt.date(2021, 1, 4): (2.0, None), dt.date(2021, 1, 11): (0.0, -2.0),
                   dt.date(2021, 1, 18): (1.0, 1.0), dt.date(2021, 1, 25): (0.0, -1.0)}
