"""Report aggregations and pivots (A1-A9), the footer row (A7), the
developer-by-day grid (J4) and the report sort (O1).

Every report is one declarative plan: range filter (pushed to the scan),
one hash aggregation with partial (map-side) aggregation, and for the wide
reports a pivot over an explicit value list, so no extra job discovers the
pivot values. Hours are summed as integer hundredths, so results do not depend
on the order rows arrive in, and come out as DOUBLE.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourbook.functions import exprs as X
from hourbook.functions import ranges as R
from hourbook.operators.filters import in_date_range, recent_weeks, ts_lit
from hourbook.operators.projections import validate_issue_group, validate_worklog_group

# Fixed values of the reports.
WEEK_COLUMNS = ("ThisWeek", "LastWeek", "TwoWeeks", "ThreeWeeks", "FourWeeks")
WEEKDAYS_SUNDAY_FIRST = ("Sunday", "Monday", "Tuesday", "Wednesday",
                         "Thursday", "Friday", "Saturday")
WORKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
DEVELOPER_COL = " Developer"         # wide timesheet: leading space sorts first
TOTAL_COL = " Total Hrs"
DAY_LABEL = "%b %d"                  # day columns of the timesheet


def _hours_from_seconds_sum(x):
    return X.round2(X.zero_if_null(x).cast("double") / X.SECONDS_PER_HOUR)


# A1 -----------------------------------------------------------------------------
def issues_grouped_by(issue: DataFrame, group: str, start, stop,
                      hours: str = "resolved") -> DataFrame:
    """Per group key, issues updated in [start, stop]: resolved and
    non-resolved counts, truncated mean days-to-resolve of resolved issues,
    and hours spent / estimated (resolved issues only, or ``hours="all"``).
    """
    if hours not in ("resolved", "all"):
        raise ValueError("hours must be 'resolved' or 'all'")
    key = validate_issue_group(group)
    res = F.col("isResolved")
    spent, est = F.col("aggregateTimeSpent"), F.col("aggregateTimeOriginalEstimate")
    if hours == "resolved":
        spent, est = F.when(res, spent), F.when(res, est)
    return (in_date_range(issue, "updateDate", start, stop)
            .groupBy(F.col(key).alias("groupBy"))
            .agg(F.count_if(~res).alias("nonResolved"),
                 F.count_if(res).alias("resolved"),
                 X.zero_if_null(X.trunc_avg(F.when(res, F.col("daysToResolve"))))
                 .alias("daysToResolve"),
                 _hours_from_seconds_sum(F.sum(spent)).alias("timeSpent"),
                 _hours_from_seconds_sum(F.sum(est)).alias("timeEstimate")))


# A2 -----------------------------------------------------------------------------
def issue_accuracy(issue: DataFrame, start, stop,
                   include_unestimated: bool = False) -> DataFrame:
    """Per developer, resolved issues updated in [start, stop]: count and
    ``100 - |(estimate - spent) / estimate * 100|`` rounded to 2 places.

    Issues without an estimate are left out (and not counted) unless
    ``include_unestimated``; a zero estimate sum then gives NULL.
    """
    df = in_date_range(issue, "updateDate", start, stop).where(F.col("isResolved"))
    if not include_unestimated:
        df = df.where(F.col("aggregateTimeOriginalEstimate") > 0)
    est = F.sum("aggregateTimeOriginalEstimate").cast("double")
    spent = F.sum("aggregateTimeSpent").cast("double")
    accuracy = F.lit(100.0) - F.abs(X.safe_ratio(est - spent, est) * 100.0)
    return (df.groupBy("developer")
            .agg(F.count(F.lit(1)).alias("count"),
                 X.round2(accuracy).alias("accuracy")))


def overall_accuracy(issue: DataFrame, start, stop,
                     include_unestimated: bool = False) -> DataFrame:
    """A2 over all developers together (one row)."""
    df = in_date_range(issue, "updateDate", start, stop).where(F.col("isResolved"))
    if not include_unestimated:
        df = df.where(F.col("aggregateTimeOriginalEstimate") > 0)
    est = F.sum("aggregateTimeOriginalEstimate").cast("double")
    spent = F.sum("aggregateTimeSpent").cast("double")
    accuracy = F.lit(100.0) - F.abs(X.safe_ratio(est - spent, est) * 100.0)
    return df.agg(F.count(F.lit(1)).alias("count"),
                  X.round2(accuracy).alias("accuracy"))


# A3 -----------------------------------------------------------------------------
def worklogs_group_by(worklog: DataFrame, group: str, start, stop) -> DataFrame:
    """Per group key (type, priority, project, weekday): hours logged in
    [start, stop], summed from the per-row rounded hours."""
    key = validate_worklog_group(group)
    return (in_date_range(worklog, "date", start, stop)
            .groupBy(F.col(key).alias("groupBy"))
            .agg(X.exact_sum("timeSpentHours").alias("timeSpentHrs")))


# A4 -----------------------------------------------------------------------------
def worklogs_per_dev_day(worklog: DataFrame, start, stop) -> DataFrame:
    """Long form of the timesheet: hours per (developer, day) in [start, stop]."""
    return (in_date_range(worklog, "date", start, stop)
            .groupBy(F.col("author").alias("developer"),
                     F.to_date("date").alias("day"))
            .agg(X.exact_sum("timeSpentHours").alias("timeSpentHrs")))


def _grid_days(start, stop) -> list[dt.date]:
    """Days start, start+1, ... for every whole day between start and stop."""
    s, e = R.as_datetime(start), R.as_datetime(stop)
    n = max(0, int((e - s).total_seconds() // 86400))
    return [(s + dt.timedelta(days=i)).date() for i in range(n)]


# J4 -----------------------------------------------------------------------------
def developer_day_grid(worklog: DataFrame, start, stop) -> DataFrame:
    """Complete developer x day grid, missing cells 0.0.

    Developers = authors with rows in [start, stop]; days = one per whole
    day between start and stop (the stop day itself has no cell, D10). The long
    form is gathered by developer, no more cells than the range has days, and
    the days that are missing are added, so the table is read and aggregated
    once.
    """
    days = _grid_days(start, stop)
    long = worklogs_per_dev_day(worklog, start, stop)
    if not days:
        return long.where(F.lit(False))
    first, last = (F.lit(d.isoformat()).cast("date") for d in (days[0], days[-1]))
    cell = F.struct("day", X.zero_if_null(F.col("timeSpentHrs")).cast("double").alias("timeSpentHrs"))
    own = long.groupBy("developer").agg(F.collect_list(cell).alias("own"))
    missing = F.array_except(F.sequence(first, last, F.expr("INTERVAL 1 DAY")), F.transform("own", lambda c: c["day"]))
    added = F.transform(missing, lambda d: F.struct(d.alias("day"), F.lit(0.0).alias("timeSpentHrs")))
    inside = F.filter("own", lambda c: (c["day"] >= first) & (c["day"] <= last))
    return own.select("developer", F.inline(F.concat(inside, added)))


# A5 -----------------------------------------------------------------------------
def worklogs_per_dev(worklog: DataFrame, start, stop, label_format: str = DAY_LABEL) -> DataFrame:
    """Wide timesheet: one row per developer, a 2-decimal text column per
    day ("Jan 02"), and " Total Hrs" over those day columns.

    The pivot uses the explicit day list (no distinct job), so the caller's
    range decides how many columns there are. A range that repeats a label
    (more than a year of "Jan 02") needs a ``label_format`` with the year.
    """
    days = _grid_days(start, stop)
    labels = [d.strftime(label_format) for d in days]
    if len(set(labels)) < len(labels):
        raise ValueError(f"label_format {label_format!r} gives several days of the range the same label")
    a4 = worklogs_per_dev_day(worklog, start, stop)
    if not days:
        return (a4.groupBy(F.col("developer").alias(DEVELOPER_COL))
                .agg(X.fixed2(F.lit(0.0)).alias(TOTAL_COL)))
    values = [d.isoformat() for d in days]
    wide = (a4.withColumn("day", F.col("day").cast("string"))
            .groupBy("developer").pivot("day", values)
            .agg(F.sum(X.cents("timeSpentHrs"))))
    cells = [X.zero_if_null(F.col(f"`{v}`")) for v in values]
    # one flat fold over the day cells (a chain of 366 additions would nest
    # the expression tree 366 deep)
    total = F.aggregate(F.array(*cells), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return wide.select(
        F.col("developer").alias(DEVELOPER_COL),
        X.fixed2(total / 100.0).alias(TOTAL_COL),
        *[X.fixed2(c / 100.0).alias(lbl) for c, lbl in zip(cells, labels)])


# A6 / R7 --------------------------------------------------------------------------
def week_column_names(weeks: int) -> list[str]:
    names = list(WEEK_COLUMNS[:weeks])
    names += [f"Weeks{k}" for k in range(len(names), weeks)]
    return names


def worklogs_per_dev_week(worklog: DataFrame, as_of, weeks: int = 5) -> DataFrame:
    """Per developer, hours in the ISO week of ``as_of`` and the earlier ones.

    Rows dated from midnight of as_of minus 7*weeks days are read; a row's
    bucket is the Monday-to-Monday distance to as_of's week, so it is right
    across New Year (D12). Developers with rows but none in the buckets get
    a zero row.
    """
    wk0 = R.iso_week_start(as_of).date().isoformat()
    dist = F.datediff(F.lit(wk0).cast("date"), X.week_start("date"))
    back = (dist / 7).cast("int")
    df = recent_weeks(worklog, as_of, days=7 * weeks)
    aggs = [X.zero_if_null(X.exact_sum(F.when(back == k, F.col("timeSpentHours"))))
            .cast("double").alias(name)
            for k, name in enumerate(week_column_names(weeks))]
    return df.groupBy(F.col("author").alias("Developer")).agg(*aggs)


def hours_per_week_pivot(worklog: DataFrame, as_of, weeks: int = 6) -> DataFrame:
    """A6 widened to ``weeks`` weeks."""
    return worklogs_per_dev_week(worklog, as_of, weeks=weeks)


# A7 -----------------------------------------------------------------------------
def with_average_row(df: DataFrame, columns: Sequence[str], label_col: str,
                     label: str = "Average") -> DataFrame:
    """Append a footer row holding the unweighted mean of each of
    ``columns`` over the report rows, rounded half away from zero to 2
    places; other columns are NULL.

    The report values have 2 places, so the mean is taken in integer cents
    (exact, independent of summation order). Rows and footer are two grouping
    sets over the report, which is computed once; a row of its own, left out
    afterwards, gives an empty report its footer.
    """
    plain = df.columns
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in plain]
    rows = df.withColumn("_seed", F.lit(False)).unionByName(df.sparkSession.range(1).select(*none, F.lit(True).alias("_seed")))
    sums = [F.count(F.lit(1)).alias("_rows"), F.grouping("_seed").alias("_footer")]
    for i, c in enumerate(columns):
        cents = F.round(F.col(f"_c{i}") * 100).cast("long")
        sums += [F.sum(cents).alias(f"_s{i}"), F.count(F.col(f"_c{i}")).alias(f"_n{i}")]
    keys = [*plain, "_seed"]
    # The measured columns twice: as keys, which the footer does not have, and as values.
    grouped = rows.select(*keys, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]).groupingSets([keys, []], *keys).agg(*sums)
    means = {c: F.expr(f"CASE WHEN _n{i} > 0 THEN signum(_s{i}) * "
                       f"((2 * abs(_s{i}) + _n{i}) div (2 * _n{i})) / 100.0 END")
             for i, c in enumerate(columns)}
    means[label_col] = F.lit(label)
    out = grouped.where("_footer = 1 or not _seed").select(
        *[F.when(F.col("_footer") == 1, means[c]).otherwise(F.col(c)).alias(c) if c in means else F.col(c) for c in plain],
        F.when(F.col("_footer") == 1, 1).otherwise(F.col("_rows")).cast("int").alias("_times"))
    # rows that the report holds several times
    return out.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")


# A8, A9 -----------------------------------------------------------------------------
def _week_before(worklog: DataFrame, as_of) -> DataFrame:
    """Rows of the Monday-Sunday week that contains as_of - 7 days."""
    ws = R.iso_week_start(R.as_datetime(as_of) - dt.timedelta(days=7))
    we = ws + dt.timedelta(days=7)
    rows = in_date_range(worklog, "date", ws, we)
    return rows.where(F.col("date") < ts_lit(we))


def worklogs_per_weekday(worklog: DataFrame, as_of) -> DataFrame:
    """Hours per weekday of last week, all 7 days, Sunday first, missing 0.

    One global partial aggregate of 7 conditional sums, then ``stack`` to 7
    rows, so every day is present without a literal day table.
    """
    df = _week_before(worklog, as_of)
    sums = df.agg(*[
        X.zero_if_null(X.exact_sum(F.when(F.col("weekDay") == d, F.col("timeSpentHours"))))
        .cast("double").alias(f"d{i}") for i, d in enumerate(WEEKDAYS_SUNDAY_FIRST)])
    pairs = ", ".join(f"'{d}', d{i}" for i, d in enumerate(WEEKDAYS_SUNDAY_FIRST))
    return sums.selectExpr(f"stack(7, {pairs}) AS (day, timeSpentHrs)")


def worklogs_per_dev_weekday(worklog: DataFrame, as_of) -> DataFrame:
    """Per developer, Monday..Friday hours of last week; weekend dropped, but
    a developer with weekend hours only keeps a zero row."""
    df = _week_before(worklog, as_of)
    wide = (df.groupBy(F.col("author").alias("Developer"))
            .pivot("weekDay", list(WORKDAYS))
            .agg(F.sum(X.cents("timeSpentHours"))))
    return wide.select("Developer", *[
        (X.zero_if_null(F.col(d)) / 100.0).alias(d) for d in WORKDAYS])


# O1 -------------------------------------------------------------------------------
def sort_report(df: DataFrame, *columns: str) -> DataFrame:
    """Order a final (small) report, by developer unless told otherwise."""
    if not columns:
        columns = tuple(c for c in ("developer", "Developer", DEVELOPER_COL)
                        if c in df.columns)[:1]
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in columns])


# Reports described in the tracker's documentation -------------------------------
# Fixed values of the workweek bands (R4): full week = 40 h.
FULL_WEEK_HOURS = 40.0
WORKWEEK_BANDS = ((40.0, "under 40%"), (60.0, "40-60%"))   # else "60% and more"
TOP_BAND = "60% and more"


def open_issues_older_than(issue: DataFrame, as_of, days: int) -> DataFrame:
    """Unresolved issues created more than ``days`` days before as_of,
    with their age in days."""
    limit = R.midnight(as_of) - dt.timedelta(days=days)
    today = F.lit(R.midnight(as_of).date().isoformat()).cast("date")
    return (issue.where(~F.col("isResolved") & (F.col("createDate") < ts_lit(limit)))
            .select("id", "key", "type", "status", "developer", "createDate",
                    F.datediff(today, F.to_date("createDate")).alias("ageDays")))


def resolve_days_trend(issue: DataFrame, as_of, weeks: int = 6) -> DataFrame:
    """R2: per issue type and ISO week of resolution, the number of issues
    resolved and their truncated mean days-to-resolve, for the ``weeks``
    weeks up to the week of as_of."""
    wk0 = R.iso_week_start(as_of)
    start = wk0 - dt.timedelta(weeks=weeks - 1)
    stop = wk0 + dt.timedelta(weeks=1)
    df = issue.where(F.col("isResolved") & (F.col("resolvedDate") >= ts_lit(start))
                     & (F.col("resolvedDate") < ts_lit(stop)))
    return (df.groupBy(F.col("type"), X.week_start("resolvedDate").alias("week"))
            .agg(F.count(F.lit(1)).alias("resolved"),
                 X.trunc_avg("daysToResolve").alias("daysToResolve")))


def developers_without_hours(worklog: DataFrame, start, stop) -> DataFrame:
    """(developer, day) pairs without hours logged in [start, stop], for
    every developer of the table, those without any row in the range too.

    One pass: the days with hours of each developer are collected (at most
    one per day of the range) and the other days of the range unfolded.
    """
    days = _grid_days(start, stop)
    if not days:
        return worklog.select(F.col("author").alias("developer"), F.to_date("date").alias("day")).where(F.lit(False))
    in_range = F.col("date").between(ts_lit(start), ts_lit(stop))
    long = (worklog.groupBy(F.col("author").alias("developer"), F.when(in_range, F.to_date("date")).alias("day"))
            .agg(X.exact_sum("timeSpentHours").alias("hours")))
    logged = long.groupBy("developer").agg(F.collect_set(F.when(F.col("hours") > 0, F.col("day"))).alias("logged"))
    every = F.sequence(F.lit(days[0].isoformat()).cast("date"), F.lit(days[-1].isoformat()).cast("date"),
                       F.expr("INTERVAL 1 DAY"))
    return logged.select("developer", F.explode(F.array_except(every, F.col("logged"))).alias("day"))


def _until_week_end(df: DataFrame, as_of) -> DataFrame:
    """Rows before the Monday after as_of's ISO week."""
    end = R.iso_week_start(as_of) + dt.timedelta(weeks=1)
    return df.where(F.col("date") < ts_lit(end))


def workweek_percent(worklog: DataFrame, as_of, weeks: int = 5) -> DataFrame:
    """Per developer and ISO week (from the A6 window), hours logged,
    share of a 40-hour week (2 places) and its band."""
    df = _until_week_end(recent_weeks(worklog, as_of, days=7 * weeks), as_of)
    wk = (df.groupBy(F.col("author").alias("developer"), X.week_start("date").alias("week"))
          .agg(X.exact_sum("timeSpentHours").alias("hours")))
    pct = X.round2(F.col("hours") / FULL_WEEK_HOURS * 100.0)
    band = F.when(F.col("percent") < WORKWEEK_BANDS[0][0], WORKWEEK_BANDS[0][1]) \
        .when(F.col("percent") < WORKWEEK_BANDS[1][0], WORKWEEK_BANDS[1][1]) \
        .otherwise(TOP_BAND)
    return wk.withColumn("percent", pct).withColumn("band", band)


def week_over_week_change(worklog: DataFrame, as_of, weeks: int = 6) -> DataFrame:
    """Per developer and ISO week, hours and the change from the week
    before (NULL for the developer's first week). Weeks without hours
    between the first one and the week of as_of count as 0.

    The weekly totals of a developer (at most ``weeks`` + 1) are unfolded
    to every week since the first, and the change is read from the same
    totals, so a very busy developer costs no more than any other.
    """
    df = _until_week_end(recent_weeks(worklog, as_of, days=7 * weeks), as_of)
    wk = (df.groupBy(F.col("author").alias("developer"), X.week_start("date").alias("week"))
          .agg(F.sum(X.cents("timeSpentHours")).alias("_c")))
    per = wk.groupBy("developer").agg(F.min("week").alias("_first"),
                                      F.map_from_entries(F.collect_list(F.struct("week", "_c"))).alias("_m"))
    last = F.lit(R.iso_week_start(as_of).date().isoformat()).cast("date")
    every = per.withColumn("week", F.explode(F.sequence(F.col("_first"), last, F.expr("INTERVAL 7 DAY"))))
    cents = F.coalesce(F.col("_m")[F.col("week")], F.lit(0))
    before = F.when(F.col("week") > F.col("_first"),
                    F.coalesce(F.col("_m")[F.date_sub("week", 7)], F.lit(0)))
    return every.select("developer", "week", (cents / 100.0).alias("hours"),
                        ((cents - before) / 100.0).alias("change"))
