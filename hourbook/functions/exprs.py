"""Column expressions used inside the operators (all JVM-side, codegen'd).

Every helper takes and returns ``Column``s; none runs Python per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the tracker's formats.
# Timestamp text as sent by the tracker, e.g. 2019-05-09T17:04:00.000-0500
TRACKER_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
# Length of the wall-clock part of that text (without the offset).
WALL_CLOCK_LEN = 23
# Query-string dates of the reports, e.g. 20190509
PARAM_DATE_FORMAT = "yyyyMMdd"
# Day label of the wide timesheet, e.g. "Jan 02"
DAY_LABEL_FORMAT = "MMM dd"
# Day label used once a timesheet spans more than a year
LONG_DAY_LABEL_FORMAT = "yyyy-MM-dd"
SECONDS_PER_HOUR = 3600.0
# Weekday names in dayofweek() order (1 = Sunday).
WEEKDAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MICROS_PER_DAY = 86_400_000_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Two clocks from one text ------------------------------------------------
def parse_instant(text) -> Column:
    """Instant of a tracker timestamp (offset honoured); NULL if unparseable."""
    return F.try_to_timestamp(_c(text), F.lit(TRACKER_TS_FORMAT))


def parse_wall_clock(text) -> Column:
    """The author's wall clock of a tracker timestamp, as TIMESTAMP_NTZ.

    The offset is dropped, so week, weekday and day follow local time.
    NULL when the instant itself does not parse.
    """
    t = _c(text)
    wall = F.substring(t, 1, WALL_CLOCK_LEN).try_cast("timestamp_ntz")
    return F.when(parse_instant(t).isNotNull(), wall)


# X2, X3 ---------------------------------------------------------------------
def iso_week(ts) -> Column:
    """ISO-8601 week number (2021-01-01 -> 53)."""
    return F.weekofyear(_c(ts))


def weekday_name(ts) -> Column:
    """Full English weekday name, Monday..Sunday (an array lookup on
    ``dayofweek``: no per-row date formatting). Null for null, which Spark does not
    infer of ``element_at``: a file that says "never null" cannot be read."""
    day = F.dayofweek(_c(ts))
    return F.when(day.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), day))


# X4, X10 --------------------------------------------------------------------
def round2(x) -> Column:
    """Round half away from zero to 2 places after scaling by 100.

    ``round(x, 2)`` on a double rounds the decimal text instead, which
    differs on values such as 1.005.
    """
    return F.round(_c(x) * 100) / 100


def seconds_to_hours(seconds) -> Column:
    """Seconds -> hours, rounded per row to 2 places (before any sum)."""
    return round2(_c(seconds).cast("double") / SECONDS_PER_HOUR)


def cents(x) -> Column:
    """A 2-place value as integer hundredths (exact: x*100 is within 1e-9 of
    an integer, so ``rint`` cannot hit a tie)."""
    return F.rint(_c(x) * 100).cast("long")


def exact_sum(hours) -> Column:
    """Order-independent sum of 2-place hours, returned as DOUBLE.

    Summed as integer hundredths (the same value as a DECIMAL(18,2) sum,
    without a BigDecimal per row); NULL when there are no values.
    """
    return F.sum(cents(hours)) / F.lit(100.0)


# X5, X6 ---------------------------------------------------------------------
def project_of(key) -> Column:
    """Text before the first '-' of an issue key ('' for an empty key)."""
    return F.split_part(_c(key), F.lit("-"), F.lit(1))


def to_id(text) -> Column:
    """String id -> BIGINT; NULL instead of 0 when it is not a number."""
    return _c(text).try_cast("bigint")


# X7, X8 ---------------------------------------------------------------------
def days_between_ceil(start_instant, end_instant) -> Column:
    """ceil(hours/24) between two instants; may be 0 or negative."""
    micros = F.unix_micros(_c(end_instant)) - F.unix_micros(_c(start_instant))
    return F.ceil(micros / F.lit(MICROS_PER_DAY)).cast("int")


def zero_if_null(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


# X9 --------------------------------------------------------------------------
def lower_in(x, values) -> Column:
    """Case-insensitive membership; an empty list matches nothing."""
    vals = sorted({v.lower() for v in values})
    if not vals:
        return F.lit(False)
    return F.lower(_c(x)).isin(vals)


# X12, X13 -------------------------------------------------------------------
def safe_ratio(num, den) -> Column:
    """num / den, NULL when den is 0 (ANSI mode raises on /0 otherwise)."""
    return F.try_divide(_c(num), _c(den))


def trunc_avg(x) -> Column:
    """Mean truncated toward zero, as INT."""
    return F.avg(_c(x)).cast("int")


# X14, X15 -------------------------------------------------------------------
def fixed2(x) -> Column:
    """Fixed 2-decimal text without grouping separators."""
    return F.format_string("%.2f", _c(x).cast("double"))


def day_label(d, long: bool = False) -> Column:
    return F.date_format(_c(d), LONG_DAY_LABEL_FORMAT if long else DAY_LABEL_FORMAT)


# X17, X18 -------------------------------------------------------------------
def week_start(ts) -> Column:
    """Monday of the ISO week of a timestamp or date, as DATE."""
    return F.date_trunc("week", _c(ts)).cast("date")


def month_start(ts) -> Column:
    return F.date_trunc("month", _c(ts)).cast("date")


def millis_to_ts(ms) -> Column:
    return F.timestamp_millis(_c(ms))


def ts_to_millis(ts) -> Column:
    return F.unix_millis(_c(ts).cast("timestamp"))


def ntz_to_instant(ntz) -> Column:
    """Wall clock taken as UTC (binding tables carry no offset)."""
    return _c(ntz).cast("timestamp")


def utc_lit(value: dt.datetime) -> Column:
    """An instant as a TIMESTAMP literal; a naive value is taken as UTC, an
    aware one is converted to it (the session clock is UTC)."""
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")
