"""Scalar expressions X1-X19 against hand-derived values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourbook.functions import exprs as X
from hourbook.functions import ranges as R


def one(spark, col, value=None, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


def test_wall_clock_and_instant(spark):
    s = "2023-03-07T23:40:00.000-0700"
    assert one(spark, X.parse_wall_clock, s) == dt.datetime(2023, 3, 7, 23, 40)
    instant = one(spark, lambda c: X.ts_to_millis(X.parse_instant(c)), s)
    assert instant == int(dt.datetime(2023, 3, 8, 6, 40, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_bad_timestamp_is_null(spark):
    assert one(spark, X.parse_instant, "not a date") is None
    assert one(spark, X.parse_wall_clock, "2023-13-45T99:00:00.000+0100") is None


def test_week_and_weekday_use_wall_clock(spark):
    # Monday in UTC, Sunday on the author's clock
    s = "2023-03-12T22:15:00.000-0400"
    assert one(spark, lambda c: X.weekday_name(X.parse_wall_clock(c)), s) == "Sunday"
    assert one(spark, lambda c: X.iso_week(X.parse_wall_clock(c)), s) == 10


def test_iso_week_new_year(spark):
    assert one(spark, X.iso_week, dt.date(2021, 1, 1), "date") == 53


def test_project_of_key(spark):
    assert one(spark, X.project_of, "OPS-12-3") == "OPS"
    assert one(spark, X.project_of, "") == ""
    assert one(spark, X.project_of, None) is None


def test_to_id(spark):
    assert one(spark, X.to_id, "4711") == 4711
    assert one(spark, X.to_id, "11x") is None


@pytest.mark.parametrize("sec,hours", [(1000, 0.28), (4500, 1.25), (3600, 1.0), (18, 0.01), (0, 0.0)])
def test_seconds_to_hours(spark, sec, hours):
    assert one(spark, X.seconds_to_hours, sec, "int") == hours


def test_round2_half_away_from_zero(spark):
    assert one(spark, X.round2, 2.5, "double") == 2.5
    assert one(spark, X.round2, 0.125, "double") == 0.13
    assert one(spark, X.round2, -0.125, "double") == -0.13


def test_days_between_ceil(spark):
    df = spark.createDataFrame([("2023-03-06T08:30:00.000+0100", "2023-03-09T10:00:00.000+0100"),
                                ("2023-02-27T12:00:00.000+0100", "2023-03-03T12:00:00.000+0100"),
                                ("2023-03-06T08:30:00.000+0100", "2023-03-06T08:00:00.000+0100")],
                               "c string, r string")
    out = [r[0] for r in df.select(X.days_between_ceil(X.parse_instant("c"), X.parse_instant("r")))
           .collect()]
    assert out == [4, 4, 0]


def test_fixed2_and_label(spark):
    assert one(spark, X.fixed2, 1234.5, "double") == "1234.50"
    assert one(spark, X.day_label, dt.date(2021, 2, 8), "date") == "Feb 08"


def test_lower_in(spark):
    assert one(spark, lambda c: X.lower_in(c, ["nora vale"]), "Nora Vale") is True
    assert one(spark, lambda c: X.lower_in(c, []), "Nora Vale") is False


def test_presets():
    as_of = dt.datetime(2021, 2, 10, 15, 0)        # a Wednesday
    s, e = R.preset_range("this_week", as_of)
    assert s == dt.datetime(2021, 2, 8) and e.date() == dt.date(2021, 2, 14)
    s, e = R.preset_range("last_week", as_of)
    assert s == dt.datetime(2021, 2, 1) and e.date() == dt.date(2021, 2, 7)
    s, e = R.preset_range("yesterday", as_of)
    assert s == dt.datetime(2021, 2, 9)
    s, e = R.preset_range("last_month", as_of)
    assert s == dt.datetime(2021, 1, 1) and e.date() == dt.date(2021, 1, 31)
    s, e = R.preset_range("this_month", as_of)
    assert s == dt.datetime(2021, 2, 1) and e.date() == dt.date(2021, 2, 28)
    with pytest.raises(ValueError):
        R.preset_range("fortnight", as_of)


def test_explicit_and_api_ranges():
    as_of = dt.datetime(2021, 2, 10)
    assert R.explicit_range("2021-02-01", None, as_of) == (dt.datetime(2021, 2, 1), dt.datetime(2021, 2, 8))
    assert R.explicit_range(None, "2021-02-08", as_of) == (dt.datetime(2021, 2, 1), dt.datetime(2021, 2, 8))
    assert R.api_range(as_of=as_of) == (dt.datetime(2021, 2, 3), dt.datetime(2021, 2, 11))
    assert R.api_range("20210208", "20210216", as_of) == (dt.datetime(2021, 2, 8), dt.datetime(2021, 2, 16))
    with pytest.raises(ValueError):
        R.api_range("2021-02-08", None, as_of)


def test_lookback_clamps_month_end():
    ms = R.lookback_start_ms(dt.datetime(2021, 6, 30, 12, 0))
    assert dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None) == \
        dt.datetime(2021, 2, 28, 12, 0)


def test_api_range_without_as_of():
    assert R.api_range("20190506", "20190513") == (dt.datetime(2019, 5, 6), dt.datetime(2019, 5, 13))


def test_range_edges():
    # month-end: last month of March 31 is all of February (leap year)
    s, e = R.preset_range("last_month", dt.datetime(2020, 3, 31, 9, 0))
    assert s == dt.datetime(2020, 2, 1) and e.date() == dt.date(2020, 2, 29)
    # 'lastweek' with an explicit end keeps the given end
    s, e = R.explicit_range("lastweek", "2021-02-12", dt.datetime(2021, 2, 10))
    assert s == dt.datetime(2021, 2, 1) and e == dt.datetime(2021, 2, 12)
    # both sides missing: this ISO week; across New Year the week starts in December
    s, e = R.explicit_range(None, None, dt.datetime(2021, 1, 1))
    assert s == dt.datetime(2020, 12, 28) and e.date() == dt.date(2021, 1, 3)
    assert R.iso_week_start(dt.date(2021, 1, 3)) == dt.datetime(2020, 12, 28)


def test_aware_times_become_utc(spark):
    aware = dt.datetime(2023, 3, 7, 23, 40, tzinfo=dt.timezone(dt.timedelta(hours=-7)))
    got = spark.range(1).select(X.utc_lit(aware).cast("string").alias("a"),
                                X.utc_lit(dt.datetime(2023, 3, 7, 1)).cast("string").alias("b")).first()
    assert tuple(got) == ("2023-03-08 06:40:00", "2023-03-07 01:00:00")
