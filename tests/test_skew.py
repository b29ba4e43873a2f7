"""Results stay whole and exact when one key holds a third of all rows:
one author, one issue and one parent take 1/3 of the worklogs. Checked
against a brute-force pandas computation of the same fixture."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourbook.functions.schemas import RAW_ISSUE, RAW_WORKLOG
from hourbook.operators import aggregates as A
from hourbook.operators import upsert as U
from hourbook.plans import ingest as I

N = 3000


def entries():
    rows = []
    for k in range(N):
        hot = k % 3 == 0
        author = "hot.dev" if hot else f"dev{k % 50}"
        issue = 1 if hot else 2 + k % 40
        day = dt.datetime(2021, 3, 1) + dt.timedelta(days=k % 28, hours=k % 9)
        ts = day.strftime("%Y-%m-%dT%H:%M:%S.000-0500")
        rows.append({"id": str(10_000 + k), "issueId": str(issue),
                     "author": {"displayName": author}, "started": ts, "updated": ts,
                     "timeSpentSeconds": 60 * (1 + k % 97)})
    return rows


def issues():
    out = [{"id": "1", "key": "HOT-1", "fields": {
        "created": "2021-01-01T00:00:00.000-0500", "issuetype": {"name": "Story"},
        "priority": {"name": "High"}, "status": {"name": "Open"}}}]
    for i in range(2, 42):
        parent = {"id": "1", "key": "HOT-1"} if i % 2 == 0 else None   # half are sub-tasks of 1
        out.append({"id": str(i), "key": f"ABC-{i}", "fields": {
            "created": "2021-01-01T00:00:00.000-0500", "issuetype": {"name": "Task"},
            "priority": {"name": "Low"}, "status": {"name": "Open"}, "parent": parent}})
    return out


@pytest.fixture(scope="module")
def frames(spark):
    ent = spark.createDataFrame(entries(), RAW_WORKLOG)
    iss = spark.createDataFrame(issues(), RAW_ISSUE)
    feed = ent.select(F.col("id").cast("long").alias("worklogId"),
                      F.lit(0).cast("long").alias("updatedTime"))
    return I.ingest_frames(feed, ent, iss)


def brute():
    df = pd.DataFrame([{"id": int(e["id"]), "author": e["author"]["displayName"],
                        "issue": int(e["issueId"]), "sec": e["timeSpentSeconds"],
                        "date": dt.datetime.strptime(e["started"][:19], "%Y-%m-%dT%H:%M:%S")}
                       for e in entries()])
    df["cents"] = df["sec"].map(lambda s: int(round(s / 3600 * 100 + 1e-9)))
    df["parent"] = df["issue"].map(lambda i: 1 if i == 1 or i % 2 == 0 else i)
    return df


def test_all_rows_kept(frames):
    assert frames.worklog_rows.count() == N


def test_hours_by_author_exact(spark, frames):
    got = {r.groupBy: r.timeSpentHrs for r in
           A.worklogs_group_by(frames.worklog_rows.withColumn("parentIssueType", F.col("author")),
                               "type", dt.datetime(2021, 1, 1), dt.datetime(2021, 12, 31)).collect()}
    want = brute().groupby("author")["cents"].sum() / 100.0
    assert got == pytest.approx(want.to_dict(), abs=1e-9)
    assert len(got) == 51


def test_parent_rollup_and_latest_writer(frames):
    iss = {r.id: r for r in U.upsert_issues(None, frames.issue_rows).collect()}
    b = brute()
    assert set(iss) == set(b["parent"])
    last = b.sort_values(["date", "id"]).groupby("parent").tail(1).set_index("parent")
    for pid, r in iss.items():
        assert r.developer == last.loc[pid, "author"]


def test_timesheet_hot_author(frames):
    long = {(r.developer, r.day): r.timeSpentHrs for r in A.worklogs_per_dev_day(
        frames.worklog_rows, dt.datetime(2021, 3, 1), dt.datetime(2021, 3, 31)).collect()}
    b = brute()
    want = b.groupby(["author", b["date"].dt.date])["cents"].sum() / 100.0
    assert long == pytest.approx({k: v for k, v in want.to_dict().items()}, abs=1e-9)
