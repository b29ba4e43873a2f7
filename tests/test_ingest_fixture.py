"""Ingest (S1-S3, F1, F3, J1, J2, P1, P2, K1, K2) and refresh (F5, J3, F6,
P3, K3) on small landed exports; goldens worked out by hand (FIXTURES.md)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import LAND
from hourbook.operators import upsert as U
from hourbook.plans import ingest as I
from hourbook.plans.refresh import refresh_frames
from hourbook.sources.tracker_json import (latest_issue_snapshots, read_issues,
                                           read_worklog_details, read_worklog_updates)


def frames(spark, **kw):
    return I.ingest_frames(read_worklog_updates(spark, os.path.join(LAND, "feed")),
                           read_worklog_details(spark, os.path.join(LAND, "worklogs")),
                           read_issues(spark, os.path.join(LAND, "issues")), **kw)


def test_feed_page(spark):
    rows = read_worklog_updates(spark, os.path.join(LAND, "feed")).orderBy("worklogId").collect()
    assert [r.worklogId for r in rows] == [501, 502, 503, 504]
    assert rows[0].pageSince == 1678258799999 and rows[-1].pageUntil == 1678698300000
    since = read_worklog_updates(spark, os.path.join(LAND, "feed"), since_ms=1678263600000)
    assert since.count() == 3


def test_null_aggregates_become_zero(spark):
    snaps = latest_issue_snapshots(read_issues(spark, os.path.join(LAND, "issues")))
    r = snaps.where("id = '915'").first()
    assert r.fields.aggregatetimespent is None       # raw stays NULL
    fr = frames(spark)
    iss = fr.issue_rows.where("id = 915").first()
    assert iss.aggregateTimeSpent == 0 and iss.aggregateTimeOriginalEstimate == 0


def test_worklog_golden(spark):
    fr = frames(spark)
    got = {r.id: r for r in fr.worklog_rows.collect()}
    want = {
        501: ("Nora Vale", 10, "Tuesday", 1.25, "OPS", 910, 910, "OPS-12", "Bug", "Major"),
        502: ("Imre Sol", 10, "Wednesday", 0.28, "OPS", 911, 912, "OPS-11", "Epic", "Minor"),
        503: ("Nora Vale", 10, "Sunday", 1.5, "OPS", 915, 915, "OPS-20", "Task", "Blocker"),
        504: ("Imre Sol", 11, "Monday", 0.25, "OPS", 910, 910, "OPS-12", "Bug", "Major"),
    }
    assert set(got) == set(want)
    for k, w in want.items():
        r = got[k]
        assert (r.author, r.weekNumber, r.weekDay, r.timeSpentHours, r.project, r.issueId,
                r.parentIssueId, r.parentIssueKey, r.parentIssueType, r.parentIssuePriority) == w
    assert got[501].date == dt.datetime(2023, 3, 7, 23, 40)     # wall clock, not UTC
    assert got[502].issueType == "Sub-task"


def test_issue_golden(spark):
    fr = frames(spark)
    iss = U.upsert_issues(None, fr.issue_rows, I.SEQ_ORDER)
    got = {r.id: r for r in iss.collect()}
    assert set(got) == {910, 912, 915}                          # 911 is a sub-task
    assert (got[910].isResolved, got[910].resolvedDate, got[910].daysToResolve) == (False, None, 0)
    # two entries on 910: the one updated last gives developer and date
    assert got[910].updateDate == dt.datetime(2023, 3, 13, 10, 0)
    assert got[912].isResolved and got[912].daysToResolve == 4  # four days to the minute
    assert got[912].resolvedDate == dt.datetime(2023, 3, 3, 12, 0)
    assert got[912].updateDate == dt.datetime(2023, 3, 8, 9, 15)
    assert (got[915].aggregateTimeSpent, got[915].aggregateTimeOriginalEstimate) == (0, 0)
    assert {k: r.developer for k, r in got.items()} == {910: "Imre Sol", 912: "Imre Sol", 915: "Nora Vale"}
    assert got[910].aggregateTimeSpent == 7200


def test_user_filter(spark):
    def ids(users):
        return sorted(r.id for r in frames(spark, users=users).worklog_rows.collect())

    def names(*values):
        return spark.createDataFrame([(v,) for v in values], "name string")

    for form in (list, lambda values: names(*values)):
        assert ids(form(["nora VALE"])) == [501, 503]
        assert ids(form(["x"])) == []
        assert ids(form([])) == [501, 502, 503, 504]
        assert ids(form([f"user{i}" for i in range(1500)] + ["IMRE sol"])) == [502, 504]


def test_cursor_skips_old_ids(spark):
    fr = frames(spark, max_worklog_id=502)
    assert sorted(r.id for r in fr.worklog_rows.collect()) == [503, 504]
    assert I.next_cursor(fr.feed, fr.worklog_rows) == {"max_worklog_id": 504,
                                                       "last_timestamp": 1678698300000}
    empty = frames(spark, max_worklog_id=504)
    assert I.next_cursor(empty.feed, empty.worklog_rows) is None


def test_missing_issue_and_orphan(spark, scratch):
    import json
    land = os.path.join(scratch, "land")
    os.makedirs(os.path.join(land, "worklogs"))
    os.makedirs(os.path.join(land, "issues"))
    entries = [
        {"id": "1", "issueId": "404", "author": {"displayName": "A"},
         "started": "2023-03-09T09:30:00.000+0100", "timeSpentSeconds": 60},
        {"id": "2", "issueId": "7", "author": {"displayName": "A"},
         "started": "2023-03-09T09:30:00.000+0100", "timeSpentSeconds": 60},
        {"id": "x3", "issueId": "7", "author": {"displayName": "A"},
         "started": "2023-03-09T09:30:00.000+0100", "timeSpentSeconds": 60},
    ]
    with open(os.path.join(land, "worklogs", "d.json"), "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in entries)
    with open(os.path.join(land, "issues", "7.json"), "w") as f:
        json.dump({"id": "7", "key": "OPS-7", "fields": {
            "created": "2023-03-01T00:00:00.000+0100", "parent": {"id": "99", "key": "OPS-99"},
            "issuetype": {"name": "Sub-task"}, "priority": {"name": "Low"},
            "status": {"name": "Open"}}}, f)
    feed = spark.createDataFrame([(1, 1), (2, 1)], "worklogId long, updatedTime long")
    details = read_worklog_details(spark, os.path.join(land, "worklogs"))
    fr = I.ingest_frames(feed, details, read_issues(spark, os.path.join(land, "issues")))
    wl = fr.worklog_rows.collect()
    assert [r.id for r in wl] == [2]                          # 404 issue dropped
    assert wl[0].parentIssueId is None and wl[0].parentIssueKey is None   # D18
    assert fr.issue_rows.count() == 0                          # no issue row with NULL id
    assert [r.id for r in fr.missing_issue.collect()] == ["1"]
    assert fr.orphaned.count() == 1
    # a non-numeric id is not admitted by the feed and is listed
    fr_all = I.ingest_frames(feed.union(spark.createDataFrame([(None, 1)], feed.schema)),
                             details, read_issues(spark, os.path.join(land, "issues")))
    assert fr_all.worklog_rows.count() == 1 and [r.id for r in fr_all.unnumbered.collect()] == ["x3"]


def _stored_issue(spark):
    fr = frames(spark)
    return U.upsert_issues(None, fr.issue_rows, I.SEQ_ORDER)


def test_refresh_golden(spark):
    stored = _stored_issue(spark)
    snaps = read_issues(spark, os.path.join(LAND, "issues"))
    fr = refresh_frames(stored, snaps, ["closed", "DONE"])
    got = {r.id: r for r in fr.issue.collect()}
    assert got[910].isResolved
    assert got[910].resolvedDate == got[910].updateDate == dt.datetime(2023, 3, 9, 10, 0)
    assert got[910].daysToResolve == 4                          # three days and an hour and a half
    assert not got[915].isResolved
    assert [r.id for r in fr.updates.collect()] == [910]
    # empty done list: nothing changes
    none = refresh_frames(stored, snaps, [])
    assert none.updates.count() == 0


def test_reingest_keeps_resolution(spark):
    """A later worklog on an issue closed by the refresh does not reopen it."""
    stored = _stored_issue(spark)
    snaps = read_issues(spark, os.path.join(LAND, "issues"))
    closed = refresh_frames(stored, snaps, ["done"]).issue
    late = frames(spark).issue_rows.where("id = 910").withColumn("_seq_ts", F.lit(10 ** 13))
    after = {r.id: r for r in U.upsert_issues(closed, late, I.SEQ_ORDER).collect()}
    assert after[910].isResolved and after[910].daysToResolve == 4
    assert after[910].updateDate == dt.datetime(2023, 3, 13, 10, 0)


def test_refresh_without_dates_stays_unresolved(spark):
    stored = _stored_issue(spark)
    snaps = read_issues(spark, os.path.join(LAND, "issues")).withColumn(
        "fields", F.col("fields").withField("statuscategorychangedate", F.lit(None).cast("string")))
    fr = refresh_frames(stored, snaps, ["done"])
    assert fr.updates.count() == 0
    assert [r.id for r in fr.unresolvable.collect()] == [910]


def test_replay_is_idempotent(spark):
    fr = frames(spark)
    once = U.upsert_worklogs(None, fr.worklog_rows, I.SEQ_ORDER)
    twice = U.upsert_worklogs(once, fr.worklog_rows, I.SEQ_ORDER)
    cols = [c for c in once.columns]
    assert sorted(map(tuple, once.select(cols).collect())) == \
        sorted(map(tuple, twice.select(cols).collect()))


def test_lookup_by_key_or_id(spark):
    from hourbook.sources.tracker_json import lookup_by_key_or_id
    snaps = latest_issue_snapshots(read_issues(spark, os.path.join(LAND, "issues")))
    wanted = spark.createDataFrame([("OPS-12",), ("912",), ("NOPE-1",)], "key string")
    assert sorted(r.id for r in lookup_by_key_or_id(snaps, wanted).collect()) == ["910", "912"]


def test_ties_do_not_depend_on_input_order(spark):
    """K1/K2: of versions with equal times one wins, whichever comes first."""
    rows = frames(spark).worklog_rows.where("id = 501")
    other = rows.withColumn("author", F.lit("Someone Else"))
    a = U.upsert_worklogs(None, rows.unionByName(other).coalesce(1), I.SEQ_ORDER)
    b = U.upsert_worklogs(None, other.unionByName(rows).coalesce(1), I.SEQ_ORDER)
    c = U.upsert_worklogs(U.upsert_worklogs(None, other, I.SEQ_ORDER), rows, I.SEQ_ORDER)
    d = U.upsert_worklogs(U.upsert_worklogs(None, rows, I.SEQ_ORDER), other, I.SEQ_ORDER)
    assert len({df.first().author for df in (a, b, c, d)}) == 1


def test_touch_policy_changes_only_the_date(spark):
    """K2 ``touch``: new ids are inserted, stored ones get the date alone."""
    stored = _stored_issue(spark).where("id <> 915").withColumn("developer", F.lit("kept"))
    after = {r.id: r for r in U.upsert_issues(stored.withColumn("updateDate", F.lit(None).cast("timestamp_ntz")),
                                              frames(spark).issue_rows, I.SEQ_ORDER, policy="touch").collect()}
    assert {k: r.developer for k, r in after.items()} == {910: "kept", 912: "kept", 915: "Nora Vale"}
    assert after[910].updateDate == dt.datetime(2023, 3, 13, 10, 0)


def test_many_issues_without_parent(spark):
    """Parentless issues stay out of the join and come back."""
    from hourbook.operators import joins as J
    snaps = latest_issue_snapshots(read_issues(spark, os.path.join(LAND, "issues")))
    lone = snaps.where("id = '915'").crossJoin(spark.range(50).withColumnRenamed("id", "n"))
    many = snaps.unionByName(lone.withColumn("id", (F.col("n") + 5000).cast("string")).drop("n"))
    pairs = J.issues_with_parent(many)
    assert pairs.count() == 54 and pairs.where("p is not null").count() == 1


def test_refresh_reports_missing_snapshot_and_duplicate_keys(spark):
    stored = _stored_issue(spark)
    dup = stored.where("id = 910").withColumn("id", F.lit(7000).cast("long"))
    stored2 = stored.unionByName(dup)
    snaps = read_issues(spark, os.path.join(LAND, "issues")).where("id <> '915'")
    fr = refresh_frames(stored2, snaps, ["done"])
    assert [r.id for r in fr.without_snapshot.collect()] == [915]          # D19
    assert [(r.key, r.ids) for r in fr.duplicate_keys.collect()] == [("OPS-12", 2)]   # D26
    assert sorted(r.id for r in fr.updates.collect()) == [910, 7000]


def odd_frames(spark):
    """Entries that move between issues, some of which have not landed."""
    from hourbook.functions.schemas import RAW_ISSUE, RAW_WORKLOG
    def entry(id_, issue, second, author="a"):
        at = f"2023-03-08T10:00:{second:02d}.000+0000"
        return (None, (None, None, author, True, None, None), at, at, at, "1m", 60 * second, id_, issue)
    entries = [entry("1", "10", 1), entry("1", "99", 2),                            # the later issue is missing
               entry("2", "10", 1), entry("2", "11", 2), entry("2", "10", 3, "b"),  # there and back
               entry("3", "99", 1), entry("3", "97", 2),                            # no issue at all
               entry("4", "12", 1), entry("4", "12", 2),                            # its parent is missing
               entry("5", "12", 4), entry("5", "11", 4),                            # one version twice
               entry("6", None, 5), entry("6", "11", 4), entry("x", "10", 1), entry("7", "013", 1), entry("7", "13", 2)]
    def issue(id_, parent=None):
        fields = (f"text {id_}", "2023-03-01T10:00:00.000+0000", None, None, ("Bug",), ("Minor",), ("new",), parent and (parent, "K"), 5, 6)
        return (id_, f"OPS-{id_}", fields)
    issues = [issue("10"), issue("11", "10"), issue("12", "98"), issue("13"), issue("013")]
    feed = spark.createDataFrame([(i, 1) for i in range(1, 9)], "worklogId long, updatedTime long")
    return I.ingest_frames(feed, spark.createDataFrame(entries, RAW_WORKLOG), spark.createDataFrame(issues, RAW_ISSUE))


def test_versions_chosen_before_the_lookups_are_those_chosen_after(spark):
    fr = odd_frames(spark)
    for policy in U.POLICIES:
        want = U.upsert_worklogs(None, fr.worklog_rows, I.SEQ_ORDER, policy=policy)
        chosen = U.upsert_worklogs(None, I.entry_versions(fr.entries), I.SEQ_ORDER, policy=policy, key=I.ENTRY_KEY)
        got = I.looked_up(I.written_versions(chosen, fr.pairs, policy), fr.pairs)
        assert sorted(r.id for r in got.collect()) == [1, 2, 4, 5, 6, 7]
        plain = [c for c in got.columns if not c.startswith("_")]
        assert sorted(map(str, got.where("id < 7").select(plain).collect())) == sorted(map(str, want.where("id < 7").select(plain).collect()))


def test_issues_chosen_before_their_snapshots_are_those_chosen_after(spark):
    fr = odd_frames(spark)
    touches = I.issue_touches(fr.entries, fr.pairs)

    def tables(rows):
        first = U.upsert_issues(None, rows.where("_seq_id <= 1"), I.SEQ_ORDER)
        return first, U.upsert_issues(first, rows.where("_seq_id > 1"), I.SEQ_ORDER, policy="touch"), U.upsert_issues(None, rows, I.SEQ_ORDER)
    for got, want in zip(tables(touches), tables(fr.issue_rows)):
        got = I.touched_issues(got, fr.latest)
        plain = [c for c in got.columns if not c.startswith("_")]
        assert got.count() == want.count() == got.select("id").distinct().count()
        assert sorted(map(str, got.where("id <> 13").select(plain).collect())) == sorted(map(str, want.where("id <> 13").select(plain).collect()))
