"""Explicit schemas: raw tracker JSON (never inferred) and the two tables.

Raw JSON keeps only the fields the operators read, so the JSON reader and
Parquet scans prune everything else at the source.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, NTZ = T.TimestampType(), T.TimestampNTZType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# --- raw: change feed page ("worklogs updated since") -----------------------
FEED_ITEM = T.StructType([
    _f("worklogId", L),
    _f("updatedTime", L),          # epoch milliseconds
    _f("properties", T.ArrayType(S)),
])

FEED_PAGE = T.StructType([
    _f("values", T.ArrayType(FEED_ITEM)),
    _f("since", L),
    _f("until", L),
    _f("self", S),
    _f("lastPage", B),
])

# --- raw: worklog entry -------------------------------------------------------
AUTHOR = T.StructType([
    _f("self", S),
    _f("accountId", S),
    _f("displayName", S),
    _f("active", B),
    _f("timeZone", S),
    _f("accountType", S),
])

RAW_WORKLOG = T.StructType([
    _f("self", S),
    _f("author", AUTHOR),
    _f("created", S),
    _f("updated", S),
    _f("started", S),
    _f("timeSpent", S),
    _f("timeSpentSeconds", I),
    _f("id", S),
    _f("issueId", S),
])

# --- raw: issue snapshot (only the requested fields) --------------------------
NAMED = T.StructType([_f("name", S)])
PARENT_STUB = T.StructType([_f("id", S), _f("key", S)])

ISSUE_FIELDS = T.StructType([
    _f("summary", S),
    _f("created", S),
    _f("resolutiondate", S),
    _f("statuscategorychangedate", S),
    _f("issuetype", NAMED),
    _f("priority", NAMED),
    _f("status", NAMED),
    _f("parent", PARENT_STUB),
    _f("aggregatetimespent", I),
    _f("aggregatetimeoriginalestimate", I),
])

RAW_ISSUE = T.StructType([
    _f("id", S),
    _f("key", S),
    _f("fields", ISSUE_FIELDS),
])

# --- canonical table: worklog (one row per time entry, key id) ----------------
WORKLOG = T.StructType([
    _f("id", L, False),
    _f("author", S),
    _f("date", NTZ),               # author's wall clock
    _f("started_at", TS),          # instant (UTC)
    _f("weekNumber", I),
    _f("weekDay", S),
    _f("timeSpentSeconds", I),
    _f("timeSpentHours", D),
    _f("project", S),
    _f("issueId", L),
    _f("issueKey", S),
    _f("issueType", S),
    _f("issueSummary", S),
    _f("issuePriority", S),
    _f("issueStatus", S),
    _f("parentIssueId", L),
    _f("parentIssueKey", S),
    _f("parentIssueType", S),
    _f("parentIssueSummary", S),
    _f("parentIssuePriority", S),
    _f("parentIssueStatus", S),
])

WORKLOG_COLUMNS = [f.name for f in WORKLOG.fields]

# --- canonical table: issue (parent issues, key id) ----------------------------
ISSUE = T.StructType([
    _f("id", L, False),
    _f("key", S),
    _f("type", S),
    _f("summary", S),
    _f("priority", S),
    _f("status", S),
    _f("createDate", NTZ),         # wall clock of the creation
    _f("created_at", TS),          # creation instant, for day counts
    _f("updateDate", NTZ),
    _f("resolvedDate", NTZ),
    _f("isResolved", B),
    _f("daysToResolve", I),
    _f("aggregateTimeSpent", I),
    _f("aggregateTimeOriginalEstimate", I),
    _f("project", S),
    _f("developer", S),
])

ISSUE_COLUMNS = [f.name for f in ISSUE.fields]


# --- stored forms: the table plus the version of the row's last writer --------
# (_seq_ts = update instant of the worklog entry that wrote it, in ms;
#  _seq_id = that entry's id), so "latest wins" does not depend on how the
# input was cut into batches or in which order batches arrived.
# dateInserted: when the row was first written (kept by later updates).
SEQ_FIELDS = [_f("_seq_ts", L), _f("_seq_id", L)]
INSERTED = _f("dateInserted", TS)
WORKLOG_STORED = T.StructType(WORKLOG.fields + [INSERTED] + SEQ_FIELDS)
ISSUE_STORED = T.StructType(ISSUE.fields + [INSERTED] + SEQ_FIELDS)

# --- state of the ingest -------------------------------------------------------
# latest snapshot of each issue, with its version
SNAPSHOT = T.StructType(RAW_ISSUE.fields + [_f("_snapshot_ts", TS), _f("_snapshot_file", S)])
# month that each ingested worklog is in (null: its author is filtered out) and
# the newest update time (ms) of its versions
PLACE = T.StructType([_f("id", L), _f("month", S), _f("newest", L)])
# entries that no feed row has named yet, or whose issue or parent (``missing_id``)
# has not landed; ``seen_at``: when they first came
WAITING = T.StructType([_f("w", RAW_WORKLOG), _f("reason", S), _f("missing_id", L), _f("seen_at", TS)])
# feed rows whose entry has not landed
WANTED = T.StructType([_f("worklogId", L), _f("updatedTime", L), _f("pageUntil", L), _f("seen_at", TS)])
