"""Ingest plan (T1 body): change feed -> new worklog ids -> entries -> user
filter -> issue + parent join -> ``worklog`` / ``issue`` rows -> upserts.

``ingest_frames`` builds every output as one lazy plan over the three raw
inputs; nothing is collected except the one-row cursor.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourbook.functions import exprs as X
from hourbook.operators import filters as FL
from hourbook.operators import joins as J
from hourbook.operators import projections as PR
from hourbook.operators import upsert as U
from hourbook.sources.tracker_json import latest_issue_snapshots

SEQ_ORDER = ("_seq_ts", "_seq_id")
# Versions of an entry that name one issue have the same issue and parent.
ENTRY_KEY = ("id", "issueId")
# What an entry and its worklog row have of their own, and what an entry gives its issue.
ENTRY_CONTENT = ("author", "date", "issueId", "started_at", "timeSpentSeconds")
TOUCH_CONTENT = ("developer", "updateDate")


@dataclass
class IngestFrames:
    worklog_rows: DataFrame          # P1 output, one row per entry version
    issue_rows: DataFrame            # P2 output, one row per entry version
    missing_issue: DataFrame         # J1 dropped entries (issue not found)
    unnumbered: DataFrame            # entries whose id is not a number, which no feed can admit
    missing_entry: DataFrame         # feed rows whose entry (or its edit) has not landed
    orphaned: DataFrame              # sub-tasks whose parent is missing
    feed: DataFrame                  # feed rows admitted by since/cursor
    joined: DataFrame                # entries with issue and parent (J1 + J2)
    entries: DataFrame               # admitted entries with their order, before J1
    latest: DataFrame                # latest snapshot per issue
    pairs: DataFrame                 # issues with their parents (J2)


def select_new_entries(feed: DataFrame, details: DataFrame, *,
                       since_ms: int | None = None,
                       max_worklog_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 bound + F1 + S2: feed rows to process and their worklog entries."""
    f = FL.new_worklogs(FL.updates_since(feed, since_ms), max_worklog_id)
    ids = f.select("worklogId")
    if "_seq_id" in details.columns:    # the id as a number, so that it stays the rows' partitioning
        return f, details.join(ids.select(F.col("worklogId").alias("_seq_id")), "_seq_id", "left_semi").select(*details.columns)
    entries = (details.withColumn("_wid", X.to_id("id"))
               .join(ids.select(F.col("worklogId").alias("_wid")), "_wid", "left_semi")
               .drop("_wid"))
    return f, entries


def feed_missing_entry(feed: DataFrame, details: DataFrame) -> DataFrame:
    """Feed rows without a landed entry of their id that is as new as the
    change they tell of. An entry without an update time counts as new."""
    updated = F.unix_millis(X.parse_instant("updated"))
    landed = details.select(X.to_id("id").alias("_wid"), updated.alias("_updated"))
    as_new = F.coalesce(landed["_updated"] >= feed["updatedTime"], F.lit(True))
    return feed.join(landed, (feed["worklogId"] == landed["_wid"]) & as_new, "left_anti")


def with_sequence(entries: DataFrame) -> DataFrame:
    """Version order of an entry: its update instant (ms), then its id."""
    ts = F.coalesce(X.parse_instant("updated"), X.parse_instant("started"))
    return (entries.withColumn("_seq_ts", F.unix_millis(ts))
            .withColumn("_seq_id", X.to_id("id")))


def ingest_frames(feed: DataFrame, details: DataFrame, issue_snapshots: DataFrame, *,
                  since_ms: int | None = None, max_worklog_id: int | None = None,
                  users: Iterable[str] | DataFrame | None = None) -> IngestFrames:
    """One run over whole exports (``plans.jobs`` ingests them piece by piece)."""
    f, entries = select_new_entries(feed, with_sequence(details), since_ms=since_ms, max_worklog_id=max_worklog_id)
    unnumbered = FL.filter_users(details.where(X.to_id("id").isNull()), users,
                                 author_col="author.displayName")
    entries = FL.filter_users(entries, users, author_col="author.displayName")
    latest = latest_issue_snapshots(issue_snapshots)
    pairs = J.issues_with_parent(latest)
    joined = J.worklogs_with_issue(entries, pairs)
    return IngestFrames(
        worklog_rows=PR.to_worklog_items(joined),
        issue_rows=PR.to_parent_issues(joined),
        missing_issue=J.worklogs_missing_issue(entries, latest),
        unnumbered=unnumbered,
        missing_entry=feed_missing_entry(f, details),
        orphaned=J.orphaned_subtasks(pairs),
        feed=f,
        joined=joined,
        entries=entries,
        latest=latest,
        pairs=pairs)


def shown_fields(details: DataFrame) -> DataFrame:
    """Entries with the fields that P1, P2 and the version order read. Records that
    are moved as a whole would take the others along."""
    author = F.struct(F.col("author.displayName").alias("displayName")).alias("author")
    return details.select("id", "issueId", author, "started", "updated", "timeSpentSeconds")


def entry_versions(entries: DataFrame) -> DataFrame:
    """Entries as K1 chooses among them by ``ENTRY_KEY``, before any lookup.
    ``moved``: the versions of the id name several issues. Those without an id or
    an issue are never written."""
    rows = entries.select(F.col("_seq_id").alias("id"), X.to_id("issueId").alias("issueId"),
                          F.col("author.displayName").alias("author"), "started", "timeSpentSeconds", *SEQ_ORDER)
    of_id = Window.partitionBy("id")
    moved = F.min("issueId").over(of_id) != F.max("issueId").over(of_id)
    return rows.where("id is not null and issueId is not null").withColumn("moved", moved)


def issue_ids(pairs: DataFrame) -> DataFrame:
    """Id of each issue and of the issue that is written with its entries (P2; null:
    the parent is missing). No other field of a snapshot is moved."""
    has_parent = F.col("i.fields.parent.id").isNotNull()
    written = F.when(has_parent, F.col("p.id")).otherwise(F.col("i.id"))
    return pairs.select("_issue_id", X.to_id(written).alias("parentIssueId"))


def written_versions(versions: DataFrame, pairs: DataFrame, policy: str = "replace") -> DataFrame:
    """K1 by id over versions chosen by ``ENTRY_KEY``. An entry that names one issue
    has one version left, which is written if the issue has landed (J1). Only of the
    others it matters which issues and parents have landed."""
    moved = versions.where("moved").join(issue_ids(pairs), F.col("issueId") == F.col("_issue_id"), "inner")
    chosen = U.upsert_worklogs(None, moved.drop("_issue_id"), SEQ_ORDER, policy=policy)
    return versions.where("not moved").unionByName(chosen.select(*versions.columns)).drop("moved")


def looked_up(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """J1 and P1 of one version per id: one row per id, also where two snapshot ids
    are one number."""
    by = Window.partitionBy("_issue_id").orderBy("i.id", "p.id")
    one = pairs.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    author = F.struct(F.col("author").alias("displayName")).alias("author")
    return PR.to_worklog_items(J.worklogs_with_issue(versions.withColumn("author", author), one))


def issue_links(wanted: DataFrame, issues: DataFrame, parents: DataFrame) -> DataFrame:
    """J2 by ids, for the issue ids ``_iid`` that entries name: the issue that is written
    with an entry (``parentIssueId``, null: its parent is missing), whether the issue is
    ``missing``, the ``orphan`` (id, key, id of its parent) it is if the parent is, and the
    issue whose resolution date is no time (``unreadable``, id and key)."""
    found = wanted.join(issues, "_iid", "left")
    sub = F.col("_parent").isNotNull()
    near = parents.select(F.col("_iid").alias("_pid"), F.col("_bad").alias("_pbad"), F.lit(True).alias("_there"))
    with_parent = found.where(sub).withColumn("_pid", X.to_id("_parent")).join(near, "_pid", "left")
    alone = found.where(~sub).withColumns({"_pid": F.lit(None).cast("long"), "_pbad": F.lit(None).cast("boolean"), "_there": F.lit(None).cast("boolean")})
    rows = with_parent.unionByName(alone)
    named = F.struct("id", "key")
    return rows.select(
        "_iid", F.col("id").isNull().alias("missing"),
        F.when(sub, F.when(F.col("_there"), F.col("_pid"))).otherwise(F.when(F.col("id").isNotNull(), F.col("_iid"))).alias("parentIssueId"),
        F.when(sub & F.col("_there").isNull(), F.struct("id", "key", F.col("_pid").alias("parent"))).alias("orphan"),
        F.when(F.when(sub, F.col("_pbad")).otherwise(F.col("_bad")), named).alias("unreadable"))


def snapshot_ids(snapshots: DataFrame) -> DataFrame:
    """What ``issue_links`` reads of a snapshot."""
    text = F.col("fields.resolutiondate")
    return snapshots.select(X.to_id("id").alias("_iid"), "id", "key", F.col("fields.parent.id").alias("_parent"),
                            (text.isNotNull() & X.parse_instant(text).isNull()).alias("_bad"))


def linked_entries(entries: DataFrame, links: DataFrame) -> DataFrame:
    """J1 by ids: entries (``with_sequence``) whose issue has landed, with what K1 and K2
    choose by. No text of an issue is moved."""
    w = entries.select(F.col("_seq_id").alias("id"), X.to_id("issueId").alias("issueId"), F.col("author.displayName").alias("author"),
                       "started", "timeSpentSeconds", *SEQ_ORDER, *[c for c in entries.columns if c.startswith("_") and c not in SEQ_ORDER])
    there = links.where(~F.col("missing")).select("_iid", "parentIssueId", "orphan")
    return w.join(there, F.col("issueId") == F.col("_iid"), "inner").drop("_iid")


def chosen_entries(linked: DataFrame, policy: str = "replace") -> DataFrame:
    """K1 over the entries of a batch, before their texts are looked up."""
    wall, instant = X.parse_wall_clock("started").alias("date"), X.parse_instant("started").alias("started_at")
    rows = linked.select("id", "issueId", "author", "started", "timeSpentSeconds", "parentIssueId", *SEQ_ORDER, wall, instant)
    chosen = U.upsert_worklogs(None, rows, SEQ_ORDER, policy=policy, content=ENTRY_CONTENT)
    return chosen.drop("parentIssueId", "date", "started_at")


def chosen_touches(linked: DataFrame) -> DataFrame:
    """K2 over the entries of a batch, before the issues' texts are looked up."""
    rows = linked.select(F.col("parentIssueId").alias("id"), X.parse_wall_clock("started").alias("updateDate"),
                         F.col("author").alias("developer"), *SEQ_ORDER)
    return U.upsert_issues(None, rows, SEQ_ORDER, content=TOUCH_CONTENT)


def issue_touches(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """What K2 chooses by, one row per entry: the id of the issue that is written
    with it, the new update date and developer."""
    w = entries.select(X.to_id("issueId").alias("_wl_issue_id"), X.parse_wall_clock("started").alias("updateDate"),
                       F.col("author.displayName").alias("developer"), *SEQ_ORDER)
    rows = w.join(issue_ids(pairs), F.col("_wl_issue_id") == F.col("_issue_id"), "inner")
    return rows.select(F.col("parentIssueId").alias("id"), "updateDate", "developer", *SEQ_ORDER)


def touched_issues(touches: DataFrame, latest: DataFrame) -> DataFrame:
    """P2 of the issues that K2 chose, each with its own latest snapshot."""
    snapshots = latest.select(X.to_id("id").alias("id"), F.struct("id", "key", "fields").alias("i"))
    return PR.to_written_issues(touches.join(U.latest_per_id(snapshots, ()), "id", "inner"))


def cursor_frame(feed_rows: DataFrame, worklog_rows: DataFrame) -> DataFrame:
    """K4 as one row: the max written worklog id, the max page ``until`` (or
    update time) of the admitted feed rows, and how many were admitted.

    One aggregate over the union of both inputs (no join of the two).
    """
    until = "pageUntil" if "pageUntil" in feed_rows.columns else "updatedTime"
    f = feed_rows.select(F.lit(None).cast("long").alias("_id"),
                         F.coalesce(F.col(until), F.col("updatedTime")).alias("_t"),
                         F.lit(1).alias("_n"))
    w = worklog_rows.select(F.col("id").alias("_id"), F.lit(None).cast("long").alias("_t"),
                            F.lit(0).alias("_n"))
    return f.unionByName(w).agg(F.max("_id").alias("max_worklog_id"),
                                F.max("_t").alias("last_timestamp"),
                                F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("admitted"))


def next_cursor(feed_rows: DataFrame, worklog_rows: DataFrame) -> dict | None:
    """K4 value after a fully processed batch (one small row on the driver);
    None when the feed admitted nothing."""
    row = cursor_frame(feed_rows, worklog_rows).first()
    if row is None or row["admitted"] == 0:
        return None
    return {"max_worklog_id": row["max_worklog_id"], "last_timestamp": row["last_timestamp"]}
