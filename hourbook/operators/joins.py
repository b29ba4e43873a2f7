"""Joins (J1-J3). The tracker resolves each worklog by REST lookups; here
every lookup is one equi-join, planned by Catalyst/AQE (broadcast when the
measured side is small, sort-merge otherwise, skewed keys split by AQE).

Raw records travel as structs: ``w`` (worklog entry), ``i`` (its issue),
``p`` (the issue's parent snapshot, NULL when there is none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourbook.functions import exprs as X


def _as_struct(df: DataFrame, name: str, keep_prefix: str = "_") -> DataFrame:
    body = [c for c in df.columns if not c.startswith(keep_prefix)]
    carry = [c for c in df.columns if c.startswith(keep_prefix)]
    return df.select(F.struct(*body).alias(name), *carry)


def issues_with_parent(issues: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Each issue snapshot ``i`` with its parent snapshot ``p``.

    A left join on parent id to ``parents`` (default: ``issues``): an issue without a parent gets NULL ``p``
    (and is its own parent in P1/P2); a parent that is missing also gives
    NULL ``p`` and is caught by ``orphaned_subtasks``. Done once per issue,
    so the larger worklog side is shuffled only once (in J1). Issues without
    a parent take no part in the join (their NULL keys would all meet in one
    partition) and are added afterwards.
    """
    body = [c for c in issues.columns if not c.startswith("_")]
    i = issues.select(F.struct(*body).alias("i"),
                      X.to_id(F.col("fields.parent.id")).alias("_parent_id"),
                      X.to_id(F.col("id")).alias("_issue_id"))
    p = (issues if parents is None else parents).select(F.struct(*body).alias("p"), X.to_id(F.col("id")).alias("_pid"))
    sub = i.where(F.col("_parent_id").isNotNull())
    found = sub.join(p, sub["_parent_id"] == p["_pid"], "left").select("i", "p", "_issue_id")
    none = F.lit(None).cast(p.schema["p"].dataType).alias("p")
    return found.unionByName(i.where(F.col("_parent_id").isNull()).select("i", none, "_issue_id"))


def orphaned_subtasks(issue_pairs: DataFrame) -> DataFrame:
    """Sub-tasks whose parent snapshot is missing (D18 reject output)."""
    return issue_pairs.where(F.col("i.fields.parent.id").isNotNull() & F.col("p").isNull())


def worklogs_with_issue(worklogs: DataFrame, issue_pairs: DataFrame) -> DataFrame:
    """Each raw worklog (as ``w``) with its issue ``i`` and parent ``p``.

    Inner join on the issue id: a worklog whose issue is missing is
    dropped (the tracker's 404 case); ``worklogs_missing_issue`` lists them.
    Columns of ``worklogs`` starting with ``_`` are carried through.
    """
    w = _as_struct(worklogs, "w").withColumn("_wl_issue_id", X.to_id(F.col("w.issueId")))
    return (w.join(issue_pairs, w["_wl_issue_id"] == issue_pairs["_issue_id"], "inner")
            .drop("_wl_issue_id", "_issue_id"))


def worklogs_missing_issue(worklogs: DataFrame, issues: DataFrame) -> DataFrame:
    """J1's dropped rows: worklogs whose issue snapshot does not exist."""
    ids = issues.select(X.to_id(F.col("id")).alias("_iid"))
    return (worklogs.withColumn("_iid", X.to_id(F.col("issueId")))
            .join(ids, "_iid", "left_anti").drop("_iid"))


def refresh_unresolved(stored: DataFrame, latest: DataFrame) -> DataFrame:
    """Each stored unresolved issue ``s`` with its latest snapshot ``n``,
    matched by key. Stored issues without a snapshot are skipped (D19);
    ``unresolved_without_snapshot`` lists them."""
    body = [c for c in latest.columns if not c.startswith("_")]
    s = stored.select(F.struct(*stored.columns).alias("s"), F.col("key").alias("_k"))
    n = latest.select(F.struct(*body).alias("n"), F.col("key").alias("_nk"))
    return s.join(n, s["_k"] == n["_nk"], "inner").drop("_k", "_nk")


def unresolved_without_snapshot(stored: DataFrame, latest: DataFrame) -> DataFrame:
    return stored.join(latest.select(F.col("key")), "key", "left_anti")
