"""Registered ingest queries over raw tracker exports derived from the
driver's tables (``sources.binding.raw_*``), and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourbook.functions import ranges as R
from hourbook.operators import filters as FL
from hourbook.operators import joins as J
from hourbook.operators import upsert as U
from hourbook.plans import ingest as I
from hourbook.plans import params as P
from hourbook.sources import binding as B
from hourbook.sources.tables import read_table
from hourbook.sources.tracker_json import latest_issue_snapshots

# Cursor of an earlier run (worklog ids above it are new): half of the id range.
CURSOR_SQL = "(SELECT max(l_orderkey) * 5 FROM lineitem)"


def feed_cursor(spark: SparkSession, sf_dir: str) -> int:
    return int(read_table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey") * 5).first()[0] or 0)


def _frames(spark: SparkSession, sf_dir: str, **kw) -> I.IngestFrames:
    return I.ingest_frames(B.raw_feed(spark, sf_dir), B.raw_worklogs(spark, sf_dir),
                           B.raw_issues(spark, sf_dir), **kw)


def _public(df: DataFrame) -> DataFrame:
    """Drop internal columns (carried order keys, UTC instants)."""
    return df.select(*[c for c in df.columns if not c.startswith("_")
                       and c not in ("started_at", "created_at", "dateInserted",
                                     "month", "block")])


def q_read_worklog_updates(spark, sf_dir):
    """S1 + F2: feed rows since as_of minus 4 months (no cursor yet)."""
    since = R.lookback_start_ms(P.AS_OF)
    return FL.updates_since(B.raw_feed(spark, sf_dir), since).select("worklogId", "updatedTime")


def q_new_worklogs(spark, sf_dir):
    """feed rows above the cursor of an earlier run."""
    return FL.new_worklogs(B.raw_feed(spark, sf_dir), feed_cursor(spark, sf_dir)).select(
        "worklogId", "updatedTime")


def q_read_worklog_details(spark, sf_dir):
    """Entries of the new feed ids (semi join on id)."""
    _, entries = I.select_new_entries(B.raw_feed(spark, sf_dir), B.raw_worklogs(spark, sf_dir),
                                      max_worklog_id=feed_cursor(spark, sf_dir))
    return entries.select(F.col("id"), "issueId", F.col("author.displayName").alias("author"),
                          "started", "updated", "timeSpentSeconds")


def q_read_issues(spark, sf_dir):
    """S3: latest snapshot per issue, flattened."""
    return flat_issues(latest_issue_snapshots(B.raw_issues(spark, sf_dir)))


def flat_fields(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the fields that ``flat_issues`` shows. The latest of an id is
    picked as a whole record, so Spark would move the others too."""
    names = ("status", "created", "resolutiondate", "aggregatetimespent")
    parent = F.struct(F.col("fields.parent.id").alias("id")).alias("parent")
    return snapshots.withColumn("fields", F.struct(parent, *(F.col(f"fields.{n}") for n in names)))


def flat_issues(latest: DataFrame) -> DataFrame:
    return latest.select("id", "key", F.col("fields.parent.id").alias("parentId"),
                         F.col("fields.status.name").alias("status"),
                         F.col("fields.created").alias("created"),
                         F.col("fields.resolutiondate").alias("resolutiondate"),
                         F.col("fields.aggregatetimespent").alias("aggregatetimespent"))


def q_issues_with_parent(spark, sf_dir):
    """Issue -> parent (itself when it has none)."""
    pairs = J.issues_with_parent(B.raw_issues(spark, sf_dir))
    has = F.col("i.fields.parent.id").isNotNull()
    return pairs.select(
        F.col("i.id").alias("issueId"),
        F.when(has, F.col("p.id")).otherwise(F.col("i.id")).alias("parentIssueId"),
        F.when(has, F.col("p.key")).otherwise(F.col("i.key")).alias("parentIssueKey"),
        F.when(has, F.col("p.fields.priority.name"))
        .otherwise(F.col("i.fields.priority.name")).alias("parentIssuePriority"))


def q_worklogs_with_issue(spark, sf_dir):
    """Every entry version with its issue."""
    pairs = J.issues_with_parent(B.raw_issues(spark, sf_dir))
    joined = J.worklogs_with_issue(B.raw_worklogs(spark, sf_dir), pairs)
    return joined.select(F.col("w.id").alias("id"), F.col("i.id").alias("issueId"),
                         F.col("i.key").alias("issueKey"))


def q_to_worklog_items(spark, sf_dir):
    """All entry versions flattened to worklog rows."""
    return _public(_frames(spark, sf_dir).worklog_rows)


def q_to_parent_issues(spark, sf_dir):
    """The issue row written with each entry version."""
    return _public(_frames(spark, sf_dir).issue_rows)


def _shown(spark, sf_dir, **kw) -> I.IngestFrames:
    return I.ingest_frames(B.raw_feed(spark, sf_dir), I.shown_fields(B.raw_worklogs(spark, sf_dir)),
                           B.raw_issues(spark, sf_dir), **kw)


def _worklogs(versions: DataFrame, fr: I.IngestFrames, policy: str = "replace") -> DataFrame:
    """The rows of the versions that K1 chose: only these are looked up and laid out."""
    return _public(I.looked_up(I.written_versions(versions, fr.pairs, policy), fr.pairs))


def q_upsert_worklogs(spark, sf_dir):
    """K1 (replace): latest version per worklog id."""
    fr = _shown(spark, sf_dir)
    chosen = U.upsert_worklogs(None, I.entry_versions(fr.entries), I.SEQ_ORDER, key=I.ENTRY_KEY)
    return _worklogs(chosen, fr)


def q_upsert_worklogs_keep_first(spark, sf_dir):
    """K1 (keep_first): first version per worklog id."""
    fr = _shown(spark, sf_dir)
    chosen = U.upsert_worklogs(None, I.entry_versions(fr.entries), I.SEQ_ORDER, policy="keep_first", key=I.ENTRY_KEY)
    return _worklogs(chosen, fr, "keep_first")


def q_upsert_worklogs_two_batches(spark, sf_dir):
    """K1 in two batches: ids up to the cursor first, then the rest (replace)."""
    fr1, cursor = _shown(spark, sf_dir), feed_cursor(spark, sf_dir)
    first = I.entry_versions(fr1.entries).where(F.col("id") <= cursor)
    stored = U.upsert_worklogs(None, first, I.SEQ_ORDER, key=I.ENTRY_KEY)
    fr2 = _shown(spark, sf_dir, max_worklog_id=cursor)
    both = U.upsert_worklogs(stored, I.entry_versions(fr2.entries), I.SEQ_ORDER, key=I.ENTRY_KEY)
    return _worklogs(both, fr2)


def q_upsert_issues(spark, sf_dir):
    """K2: issue table after ingesting every entry version."""
    fr = _shown(spark, sf_dir)
    chosen = U.upsert_issues(None, I.issue_touches(fr.entries, fr.pairs), I.SEQ_ORDER)
    return _public(I.touched_issues(chosen, fr.latest))


def q_upsert_issues_touch(spark, sf_dir):
    """K2 (touch) in two batches: an issue that is stored only gets the new
    update date."""
    fr, cursor = _shown(spark, sf_dir), feed_cursor(spark, sf_dir)
    rows = I.issue_touches(fr.entries, fr.pairs)
    stored = U.upsert_issues(None, rows.where(F.col("_seq_id") <= cursor), I.SEQ_ORDER)
    later = rows.where(F.col("_seq_id") > cursor)
    return _public(I.touched_issues(U.upsert_issues(stored, later, I.SEQ_ORDER, policy="touch"), fr.latest))


def q_filter_users_ingest(spark, sf_dir):
    """F3 inside the ingest: only entries of listed authors are written."""
    users = ["Supplier#000000010", "supplier#000000020"]
    return _public(_frames(spark, sf_dir, users=users).worklog_rows)


def q_advance_cursor(spark, sf_dir):
    """K4: the cursor after a run that admitted the ids above the feed cursor."""
    fr = _frames(spark, sf_dir, max_worklog_id=feed_cursor(spark, sf_dir))
    return I.cursor_frame(fr.feed, fr.worklog_rows)


INGEST_QUERIES = {
    "advance_cursor": q_advance_cursor,
    "read_worklog_updates": q_read_worklog_updates,
    "new_worklogs": q_new_worklogs,
    "read_worklog_details": q_read_worklog_details,
    "read_issues": q_read_issues,
    "issues_with_parent": q_issues_with_parent,
    "worklogs_with_issue": q_worklogs_with_issue,
    "to_worklog_items": q_to_worklog_items,
    "to_parent_issues": q_to_parent_issues,
    "upsert_worklogs": q_upsert_worklogs,
    "upsert_worklogs_keep_first": q_upsert_worklogs_keep_first,
    "upsert_worklogs_two_batches": q_upsert_worklogs_two_batches,
    "upsert_issues": q_upsert_issues,
    "upsert_issues_touch": q_upsert_issues_touch,
    "filter_users_ingest": q_filter_users_ingest,
}


# --- oracle ------------------------------------------------------------------------
OFFSET_MS = 7_200_000   # RAW_OFFSET +0200 in ms

RAW_CTE = f"""
vl AS (
  SELECT *, l_orderkey * 10 + l_linenumber AS wid,
         row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber
                            ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS version
  FROM lineitem),
feed AS (
  SELECT wid AS worklogId, epoch_ms(l_shipdate) + version - {OFFSET_MS} AS updatedTime FROM vl),
rw AS (
  SELECT vl.wid AS id, s.s_name AS author, vl.l_shipdate AS date,
         strftime(vl.l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || '+0200' AS started,
         strftime(vl.l_shipdate + to_milliseconds(vl.version), '%Y-%m-%dT%H:%M:%S.%g') || '+0200' AS updated,
         CAST(vl.l_quantity * 600 AS INTEGER) AS timeSpentSeconds,
         vl.l_orderkey AS issueId,
         epoch_ms(vl.l_shipdate) + vl.version - {OFFSET_MS} AS seq_ts
  FROM vl LEFT JOIN supplier s ON vl.l_suppkey = s.s_suppkey),
lpo AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
fo AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey),
ri AS (
  SELECT o.o_orderkey AS id,
         concat_ws('-', n.n_name, CAST(o.o_orderkey AS VARCHAR)) AS key,
         c.c_mktsegment AS type,
         'Order ' || CAST(o.o_orderkey AS VARCHAR) AS summary,
         o.o_orderpriority AS priority,
         o.o_orderstatus AS status,
         CASE WHEN fo.first_key <> o.o_orderkey THEN fo.first_key END AS parent_id,
         o.o_orderdate AS created,
         CASE WHEN o.o_orderstatus = 'F' THEN coalesce(lpo.last_ship, o.o_orderdate) END AS resolution,
         CAST(trunc(lpo.qty * 600) AS INTEGER) AS spent,
         CAST(trunc(o.o_totalprice / 10) AS INTEGER) AS estimate
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN lpo ON lpo.l_orderkey = o.o_orderkey
  LEFT JOIN fo ON fo.o_custkey = o.o_custkey),
jw AS (
  SELECT rw.*, i.id AS i_id, i.key AS i_key, i.type AS i_type, i.summary AS i_summary,
         i.priority AS i_priority, i.status AS i_status, i.parent_id,
         p.id AS p_id, p.key AS p_key, p.type AS p_type, p.summary AS p_summary,
         p.priority AS p_priority, p.status AS p_status,
         CASE WHEN i.parent_id IS NOT NULL THEN p.id ELSE i.id END AS pi_id,
         CASE WHEN i.parent_id IS NOT NULL THEN p.key ELSE i.key END AS pi_key,
         CASE WHEN i.parent_id IS NOT NULL THEN p.type ELSE i.type END AS pi_type,
         CASE WHEN i.parent_id IS NOT NULL THEN p.summary ELSE i.summary END AS pi_summary,
         CASE WHEN i.parent_id IS NOT NULL THEN p.priority ELSE i.priority END AS pi_priority,
         CASE WHEN i.parent_id IS NOT NULL THEN p.status ELSE i.status END AS pi_status,
         CASE WHEN i.parent_id IS NOT NULL THEN p.created ELSE i.created END AS pi_created,
         CASE WHEN i.parent_id IS NOT NULL THEN p.resolution ELSE i.resolution END AS pi_resolution,
         CASE WHEN i.parent_id IS NOT NULL THEN p.spent ELSE i.spent END AS pi_spent,
         CASE WHEN i.parent_id IS NOT NULL THEN p.estimate ELSE i.estimate END AS pi_estimate
  FROM rw JOIN ri i ON rw.issueId = i.id LEFT JOIN ri p ON p.id = i.parent_id),
wl_rows AS (
  SELECT id, author, date, CAST(week(date) AS INTEGER) AS weekNumber, dayname(date) AS weekDay,
         timeSpentSeconds,
         round(CAST(timeSpentSeconds AS DOUBLE) / 3600.0 * 100) / 100 AS timeSpentHours,
         split_part(i_key, '-', 1) AS project,
         i_id AS issueId, i_key AS issueKey, i_type AS issueType, i_summary AS issueSummary,
         i_priority AS issuePriority, i_status AS issueStatus,
         pi_id AS parentIssueId, pi_key AS parentIssueKey, pi_type AS parentIssueType,
         pi_summary AS parentIssueSummary, pi_priority AS parentIssuePriority,
         pi_status AS parentIssueStatus,
         seq_ts, id AS seq_id
  FROM jw),
is_rows AS (
  SELECT pi_id AS id, pi_key AS key, pi_type AS type, pi_summary AS summary,
         pi_priority AS priority, pi_status AS status, pi_created AS createDate,
         date AS updateDate, pi_resolution AS resolvedDate,
         pi_resolution IS NOT NULL AS isResolved,
         CASE WHEN pi_resolution IS NOT NULL
              THEN CAST(ceil((epoch_us(pi_resolution) - epoch_us(pi_created)) / 86400000000.0) AS INTEGER)
              ELSE 0 END AS daysToResolve,
         coalesce(pi_spent, 0) AS aggregateTimeSpent,
         coalesce(pi_estimate, 0) AS aggregateTimeOriginalEstimate,
         split_part(pi_key, '-', 1) AS project,
         author AS developer,
         seq_ts, id AS seq_id
  FROM jw WHERE pi_id IS NOT NULL)"""

WL_COLS = ("id, author, date, weekNumber, weekDay, timeSpentSeconds, timeSpentHours, project, "
           "issueId, issueKey, issueType, issueSummary, issuePriority, issueStatus, "
           "parentIssueId, parentIssueKey, parentIssueType, parentIssueSummary, "
           "parentIssuePriority, parentIssueStatus")
IS_COLS = ("id, key, type, summary, priority, status, createDate, updateDate, resolvedDate, "
           "isResolved, daysToResolve, aggregateTimeSpent, aggregateTimeOriginalEstimate, "
           "project, developer")


def _raw(body: str) -> str:
    return f"WITH {RAW_CTE}\n{body}"


def _latest(table: str, cols: str, desc: bool = True) -> str:
    d = "DESC" if desc else "ASC"
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY id "
            f"ORDER BY seq_ts {d}, seq_id {d}) AS rn FROM {table}) WHERE rn = 1")


def ingest_sql() -> dict[str, str]:
    since = R.lookback_start_ms(P.AS_OF)
    return {
        "read_worklog_updates": _raw(
            f"SELECT worklogId, updatedTime FROM feed WHERE updatedTime >= {since}"),
        "advance_cursor": _raw(
            f"SELECT (SELECT max(id) FROM wl_rows WHERE id > {CURSOR_SQL}) AS max_worklog_id, "
            f"(SELECT max(updatedTime) FROM feed WHERE worklogId > {CURSOR_SQL}) AS last_timestamp, "
            f"(SELECT count(*) FROM feed WHERE worklogId > {CURSOR_SQL}) AS admitted"),
        "new_worklogs": _raw(
            f"SELECT worklogId, updatedTime FROM feed WHERE worklogId > {CURSOR_SQL}"),
        "read_worklog_details": _raw(
            "SELECT CAST(id AS VARCHAR) AS id, CAST(issueId AS VARCHAR) AS issueId, author, "
            f"started, updated, timeSpentSeconds FROM rw WHERE id > {CURSOR_SQL}"),
        "read_issues": _raw(
            "SELECT CAST(id AS VARCHAR) AS id, key, CAST(parent_id AS VARCHAR) AS parentId, status, "
            "strftime(created, '%Y-%m-%dT%H:%M:%S.%g') || '+0200' AS created, "
            "strftime(resolution, '%Y-%m-%dT%H:%M:%S.%g') || '+0200' AS resolutiondate, "
            "spent AS aggregatetimespent FROM ri"),
        "issues_with_parent": _raw(
            "SELECT CAST(i.id AS VARCHAR) AS issueId, "
            "CAST(CASE WHEN i.parent_id IS NOT NULL THEN p.id ELSE i.id END AS VARCHAR) AS parentIssueId, "
            "CASE WHEN i.parent_id IS NOT NULL THEN p.key ELSE i.key END AS parentIssueKey, "
            "CASE WHEN i.parent_id IS NOT NULL THEN p.priority ELSE i.priority END AS parentIssuePriority "
            "FROM ri i LEFT JOIN ri p ON p.id = i.parent_id"),
        "worklogs_with_issue": _raw(
            "SELECT CAST(id AS VARCHAR) AS id, CAST(i_id AS VARCHAR) AS issueId, i_key AS issueKey FROM jw"),
        "to_worklog_items": _raw(f"SELECT {WL_COLS} FROM wl_rows"),
        "to_parent_issues": _raw(f"SELECT {IS_COLS} FROM is_rows"),
        "upsert_worklogs": _raw(_latest("wl_rows", WL_COLS)),
        "upsert_worklogs_keep_first": _raw(_latest("wl_rows", WL_COLS, desc=False)),
        "upsert_worklogs_two_batches": _raw(_latest("wl_rows", WL_COLS)),
        "upsert_issues": _raw(_latest("is_rows", IS_COLS)),
        "upsert_issues_touch": _raw(f""", one AS ({_latest(f"(SELECT * FROM is_rows WHERE seq_id <= {CURSOR_SQL})", IS_COLS)}),
two AS ({_latest(f"(SELECT * FROM is_rows WHERE seq_id > {CURSOR_SQL})", IS_COLS)})
SELECT one.* REPLACE (coalesce(two.updateDate, one.updateDate) AS updateDate) FROM one LEFT JOIN two USING (id)
UNION ALL SELECT * FROM two WHERE id NOT IN (SELECT id FROM one)"""),
        "filter_users_ingest": _raw(
            f"SELECT {WL_COLS} FROM wl_rows WHERE lower(author) IN "
            "('supplier#000000010', 'supplier#000000020')"),
    }


# --- resolution refresh (J3, F6, P3, K3) over the bound issue table ------------------
# Fixed value: on the bound data, partly shipped orders ('P') count as done.
REFRESH_DONE = ("p",)


def _refresh(spark, sf_dir):
    from hourbook.plans.refresh import refresh_frames
    return refresh_frames(B.bound_issue(spark, sf_dir), B.raw_issues(spark, sf_dir),
                          REFRESH_DONE)


def q_refresh_unresolved(spark, sf_dir):
    """Stored unresolved issues matched to their latest snapshot by key."""
    from hourbook.plans.refresh import latest_per_key
    unresolved = FL.non_resolved_issues(B.bound_issue(spark, sf_dir))
    pairs = J.refresh_unresolved(unresolved, latest_per_key(B.raw_issues(spark, sf_dir)))
    return pairs.select(F.col("s.id").alias("id"), F.col("s.key").alias("key"),
                        F.col("n.fields.status.name").alias("snapshotStatus"))


def q_merge_resolution(spark, sf_dir):
    """Refreshed rows of the issues that reached a done status."""
    return _public(_refresh(spark, sf_dir).updates)


def q_apply_issue_updates(spark, sf_dir):
    """K3: the whole issue table after the refresh."""
    return _public(_refresh(spark, sf_dir).issue)


def q_merge_resolution_or_date(spark, sf_dir):
    """P3 with ``or_resolution_date``: issues stored before they were resolved
    are refreshed by their resolution date alone."""
    from hourbook.plans.refresh import refresh_frames
    stored = B.bound_issue(spark, sf_dir).withColumn("isResolved", F.lit(False))
    return _public(refresh_frames(stored, B.raw_issues(spark, sf_dir), (), or_resolution_date=True).updates)


REFRESH_QUERIES = {
    "merge_resolution_or_date": q_merge_resolution_or_date,
    "refresh_unresolved": q_refresh_unresolved,
    "merge_resolution": q_merge_resolution,
    "apply_issue_updates": q_apply_issue_updates,
}


def refresh_sql() -> dict[str, str]:
    from hourbook.plans.oracle import ISSUE_CTE
    cte = f"WITH {ISSUE_CTE},\n{RAW_CTE}"
    def merge(test: str) -> str:
        return f"""
merged AS (
  SELECT s.id, s.key, r.type, r.summary, r.priority, r.status, s.createDate,
         coalesce(r.resolution, lpo2.change) AS updateDate,
         coalesce(r.resolution, lpo2.change) AS resolvedDate,
         TRUE AS isResolved,
         CAST(ceil((epoch_us(coalesce(r.resolution, lpo2.change)) - {OFFSET_MS * 1000}
                    - epoch_us(s.createDate)) / 86400000000.0) AS INTEGER) AS daysToResolve,
         coalesce(r.spent, 0) AS aggregateTimeSpent,
         coalesce(r.estimate, 0) AS aggregateTimeOriginalEstimate,
         split_part(r.key, '-', 1) AS project,
         s.developer
  FROM issue s
  JOIN ri r ON r.key = s.key
  JOIN (SELECT o.o_orderkey AS oid, coalesce(lpo.last_ship, o.o_orderdate) AS change
        FROM orders o LEFT JOIN lpo ON lpo.l_orderkey = o.o_orderkey) lpo2 ON lpo2.oid = r.id
  WHERE {test})"""
    merged = merge("NOT s.isResolved AND lower(r.status) IN ('p')")
    return {
        "merge_resolution_or_date": f"{cte},{merge('r.resolution IS NOT NULL')}\nSELECT {IS_COLS} FROM merged",
        "refresh_unresolved": f"""{cte}
SELECT s.id, s.key, r.status AS snapshotStatus
FROM issue s JOIN ri r ON r.key = s.key WHERE NOT s.isResolved""",
        "merge_resolution": f"{cte},{merged}\nSELECT {IS_COLS} FROM merged",
        "apply_issue_updates": f"""{cte},{merged}
SELECT {IS_COLS} FROM merged
UNION ALL
SELECT {IS_COLS} FROM issue WHERE id NOT IN (SELECT id FROM merged)""",
    }
