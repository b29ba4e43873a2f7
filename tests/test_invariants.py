"""
and exactness of hour sums on random data."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hourbook.functions import exprs as X
from hourbook.operators import aggregates as A
from hourbook.sources.binding import bound_issue, bound_worklog

START, STOP = dt.datetime(1996, 1, 1), dt.datetime(1998, 12, 31)


@pytest.mark.parametrize("key", ["developer", "type", "priority", "project", "status"])
def test_a1_counts_cover_range(spark, key):
    iss = bound_issue(spark, SF_SMALL)
    rows = A.issues_grouped_by(iss, key, START, STOP).agg(
        F.sum(F.col("resolved") + F.col("nonResolved"))).first()[0]
    want = iss.where(F.col("updateDate").between(START, STOP)).count()
    assert rows == want


@pytest.mark.parametrize("key", ["type", "priority", "project", "weekday"])
def test_a3_sums_to_range_total(spark, key):
    wl = bound_worklog(spark, SF_SMALL)
    got = A.worklogs_group_by(wl, key, START, STOP).agg(F.sum("timeSpentHrs")).first()[0]
    hours = [Decimal(str(r[0])) for r in
             wl.where(F.col("date").between(START, STOP)).select("timeSpentHours").collect()]
    assert abs(got - float(sum(hours))) < 1e-6


def test_a4_long_form_matches_a3_total(spark):
    wl = bound_worklog(spark, SF_SMALL)
    a4 = A.worklogs_per_dev_day(wl, START, STOP).agg(F.sum(X.cents("timeSpentHrs"))).first()[0]
    a3 = A.worklogs_group_by(wl, "weekday", START, STOP).agg(F.sum(X.cents("timeSpentHrs"))).first()[0]
    assert a4 == a3


def test_exact_sum_random(spark):
    rnd = random.Random(7)
    rows = [(f"g{rnd.randrange(20)}", round(rnd.randrange(0, 100_000) / 100, 2)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, h double")
    got = {r.g: r.s for r in df.groupBy("g").agg(X.exact_sum("h").alias("s")).collect()}
    want = {}
    for g, h in rows:
        want[g] = want.get(g, Decimal(0)) + Decimal(str(h))
    assert got == {g: float(v) for g, v in want.items()}
