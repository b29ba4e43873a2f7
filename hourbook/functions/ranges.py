"""Report date ranges computed from ``as_of``.

These are parameters of a query, computed once on the driver from a single
timestamp; no data passes through here.
"""

from __future__ import annotations

import calendar
import datetime as dt

# Fixed values of the presets and API defaults.
PRESETS = ("yesterday", "this_week", "last_week", "this_month", "last_month")
DEFAULT_BACK_DAYS = 7                # API default start: midnight 7 days ago
DEFAULT_SPAN_DAYS = 8                # API default stop: start + 8 days
PARAM_FORMAT = "%Y%m%d"              # start/stop query parameters: YYYYMMDD


def as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    return dt.datetime.fromisoformat(str(value))


def midnight(value) -> dt.datetime:
    d = as_datetime(value)
    return dt.datetime(d.year, d.month, d.day)


def add_months(value: dt.datetime, months: int) -> dt.datetime:
    """Calendar month shift that clamps to the month end (like add_months)."""
    y, m = divmod(value.month - 1 + months, 12)
    year, month = value.year + y, m + 1
    day = min(value.day, calendar.monthrange(year, month)[1])
    return value.replace(year=year, month=month, day=day)


def lookback_start_ms(as_of, months: int = 4) -> int:
    """epoch ms of ``as_of`` minus ``months`` calendar months (UTC)."""
    start = add_months(as_datetime(as_of), -months)
    return int(start.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def iso_week_start(value) -> dt.datetime:
    d = midnight(value)
    return d - dt.timedelta(days=d.weekday())


def month_start(value) -> dt.datetime:
    d = midnight(value)
    return d.replace(day=1)


def preset_range(name: str, as_of) -> tuple[dt.datetime, dt.datetime]:
    """named range -> (start, stop) for ``in_date_range``.

    ``stop`` is the last microsecond of the last day, so a closed interval
    covers whole days (the dashboards' ``endOf`` semantics).
    """
    key = name.lower().replace(" ", "_")
    now = as_datetime(as_of)
    end_of = dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    if key == "yesterday":
        s = midnight(now) - dt.timedelta(days=1)
        return s, s + end_of
    if key == "this_week":
        s = iso_week_start(now)
        return s, s + dt.timedelta(days=6) + end_of
    if key == "last_week":
        s = iso_week_start(now) - dt.timedelta(days=7)
        return s, s + dt.timedelta(days=6) + end_of
    if key == "this_month":
        s = month_start(now)
        e = add_months(s, 1) - dt.timedelta(days=1)
        return s, e + end_of
    if key == "last_month":
        s = add_months(month_start(now), -1)
        e = month_start(now) - dt.timedelta(days=1)
        return s, e + end_of
    raise ValueError(f"unknown range preset {name!r}; valid: {', '.join(PRESETS)}")


def explicit_range(start: str | None, end: str | None, as_of) -> tuple[dt.datetime, dt.datetime]:
    """F9 with explicit days (YYYY-MM-DD): a missing side is completed by one
    week; both missing -> this ISO week; ``start='lastweek'`` -> last week."""
    if start == "lastweek":
        s, e = preset_range("last_week", as_of)
        if end:
            e = midnight(dt.date.fromisoformat(end))
        return s, e
    s = midnight(dt.date.fromisoformat(start)) if start else None
    e = midnight(dt.date.fromisoformat(end)) if end else None
    if s is not None and e is None:
        e = s + dt.timedelta(weeks=1)
    if e is not None and s is None:
        s = e - dt.timedelta(weeks=1)
    if s is None:
        return preset_range("this_week", as_of)
    return s, e


def api_range(start: str | None = None, stop: str | None = None,
              as_of=None) -> tuple[dt.datetime, dt.datetime]:
    """report API range. Default: midnight 7 days before ``as_of`` to
    that midnight + 8 days; ``start``/``stop`` override with YYYYMMDD
    (midnight at the start of that day). Raises ValueError on bad text."""
    if start is None or stop is None:
        base = midnight(as_of if as_of is not None else dt.datetime.now()) \
            - dt.timedelta(days=DEFAULT_BACK_DAYS)
        s, e = base, base + dt.timedelta(days=DEFAULT_SPAN_DAYS)
    if start is not None:
        s = dt.datetime.strptime(start, PARAM_FORMAT)
    if stop is not None:
        e = dt.datetime.strptime(stop, PARAM_FORMAT)
    return s, e
