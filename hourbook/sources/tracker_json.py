"""Readers of landed tracker exports (S1-S3), always with explicit schemas.

Land layout (one folder per export kind, any number of files):
  feed/     change-feed pages   {"values": [{"worklogId", "updatedTime"}...],
                                 "since", "until", "lastPage"}
  worklogs/ worklog entry arrays [{"id", "issueId", "author": {...}, ...}]
  issues/   issue snapshots      {"id", "key", "fields": {...}}

Every page in ``feed/`` is processed (D15). Issue snapshots are versioned
by file modification time, then file name; the latest per id wins.

Files are JSON lines (one record or array per line, splittable) or raw API
responses (one JSON document per file, ``multi_line=True``). They are read as
text and parsed here, so that batch reads and streams treat a record that is
cut off or is not JSON alike: ``malformed`` lists it, and a reader either raises
(the default) or leaves it out (``on_malformed="drop"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourbook.functions import exprs as X
from hourbook.functions.schemas import FEED_PAGE, RAW_ISSUE, RAW_WORKLOG

#: kind of export -> schema of one record; also the folder's name
KINDS = {"feed": FEED_PAGE, "worklogs": RAW_WORKLOG, "issues": RAW_ISSUE}


def read_lines(spark: SparkSession, path: str, multi_line: bool = False, modified_after: str | None = None) -> DataFrame:
    """Raw records of landed files as text, with file name and time."""
    reader = spark.read.option("wholetext", multi_line)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)  # older files are never opened
    return with_source(reader.text(path))


def with_source(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_modification_time").alias("_file_ts"), F.col("_metadata.file_name").alias("_file"))


def _records(kind: str) -> Column:
    """The records of a line, null if it is not a record of this kind or a
    list of them: a record of a feed has values, others have an id."""
    return _records_or_null(_from_json(kind), kind)


def _from_json(kind: str) -> Column:
    return F.from_json("value", T.ArrayType(KINDS[kind]), {"mode": "PERMISSIVE", "primitivesAsString": "false"})


def _records_or_null(found: Column, kind: str) -> Column:
    named = "values" if kind == "feed" else "id"
    return F.when(F.forall(found, lambda r: r.isNotNull() & r[named].isNotNull()), found)


def _blank() -> Column:
    return F.trim(F.regexp_replace("value", r"\s+", " ")) == ""


def parsed(lines: DataFrame, kind: str) -> DataFrame:
    """Records of ``kind`` with the version of their file; lines that hold
    none are left out (``malformed`` has them)."""
    rows = lines.select(F.explode(_records(kind)).alias("r"), "_file_ts", "_file")
    return rows.select("r.*", F.col("_file_ts").alias("_snapshot_ts"), F.col("_file").alias("_snapshot_file"))


def malformed(lines: DataFrame, kind: str) -> DataFrame:
    """file and value of the lines that are no records of ``kind``; blank ones
    are nothing, not malformed."""
    return lines.where(~_blank() & _records(kind).isNull()).select(F.lit(kind).alias("kind"), F.col("_file").alias("file"), "value")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines of all kinds (column ``kind``), each parsed once: its records in the
    column of its kind, or, where it holds none and is not blank, its text in ``broken``."""
    own = {k: F.when(F.col("kind") == k, _from_json(k)).alias(k) for k in KINDS}
    found = lines.select("kind", "value", "_file_ts", "_file", *own.values())
    records = {k: _records_or_null(F.col(k), k) for k in KINDS}
    none = F.coalesce(*(F.size(r) for r in records.values())).isNull()
    return found.select("kind", "_file_ts", "_file", *(r.alias(k) for k, r in records.items()),
                        F.when(none & ~_blank(), F.col("value")).alias("broken"))


def records_of(rows: DataFrame, kind: str) -> DataFrame:
    """Records of ``kind`` (as ``parsed``) of lines that ``parsed_lines`` parsed."""
    own = rows.where(F.col("kind") == kind).select(F.explode(kind).alias("r"), "_file_ts", "_file")
    return own.select("r.*", F.col("_file_ts").alias("_snapshot_ts"), F.col("_file").alias("_snapshot_file"))


def broken_of(rows: DataFrame) -> DataFrame:
    """Lines that are no records (as ``malformed``) among those ``parsed_lines`` parsed."""
    return rows.where("broken is not null").select("kind", F.col("_file").alias("file"), F.col("broken").alias("value"))


def _read(spark: SparkSession, path: str, kind: str, on_malformed: str, multi_line: bool, modified_after: str | None = None) -> DataFrame:
    lines = read_lines(spark, path, multi_line, modified_after)
    if on_malformed == "raise":
        message = F.concat(F.lit(f"malformed record ({kind}) in "), "_file", F.lit(": "), F.substring("value", 1, 200))
        broken = ~_blank() & _records(kind).isNull()
        # A filter, so that no later projection can leave the check out.
        lines = lines.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))
    elif on_malformed != "drop":
        raise ValueError(f"on_malformed is raise or drop, not {on_malformed!r}")
    return parsed(lines, kind)


def feed_rows(pages: DataFrame) -> DataFrame:
    """Flatten feed pages to one row per changed worklog."""
    return (pages
            .select(F.explode("values").alias("v"), "since", "until", "lastPage")
            .select(F.col("v.worklogId").alias("worklogId"),
                    F.col("v.updatedTime").alias("updatedTime"),
                    X.millis_to_ts(F.col("v.updatedTime")).alias("updated_at"),
                    F.col("v.properties").alias("properties"),
                    F.col("since").alias("pageSince"),
                    F.col("until").alias("pageUntil"),
                    F.col("lastPage")))


def read_worklog_updates(spark: SparkSession, path: str,
                         since_ms: int | None = None, multi_line: bool = False,
                         on_malformed: str = "raise") -> DataFrame:
    """Feed rows, optionally only those updated at or after ``since_ms``."""
    rows = feed_rows(_read(spark, path, "feed", on_malformed, multi_line))
    if since_ms is not None and since_ms > 0:
        rows = rows.where(F.col("updatedTime") >= F.lit(int(since_ms)))
    return rows


def read_worklog_details(spark: SparkSession, path: str,
                         ids: DataFrame | None = None,
                         modified_after: str | None = None,
                         multi_line: bool = False,
                         on_malformed: str = "raise") -> DataFrame:
    """Raw worklog entries; with ``ids`` (column ``worklogId``) only those.

    A record may be an array (one response); every element is a row.
    ``modified_after`` ("YYYY-MM-DDTHH:MM:SS", UTC) skips older files.
    """
    raw = _read(spark, path, "worklogs", on_malformed, multi_line, modified_after).select(*RAW_WORKLOG.fieldNames())
    if ids is not None:
        raw = (raw.withColumn("_wid", X.to_id("id"))
               .join(ids.select(F.col("worklogId").alias("_wid")), "_wid", "left_semi")
               .drop("_wid"))
    return raw


def read_issues(spark: SparkSession, path: str, modified_after: str | None = None,
                multi_line: bool = False, on_malformed: str = "raise") -> DataFrame:
    """S3: raw issue snapshots with their version (file time, file name);
    ``modified_after`` skips files landed earlier."""
    return _read(spark, path, "issues", on_malformed, multi_line, modified_after)


def snapshot_order(snapshots: DataFrame) -> list[str]:
    return [c for c in ("_snapshot_ts", "_snapshot_file") if c in snapshots.columns]


def latest_issue_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per issue id (by ``_snapshot_ts``, ``_snapshot_file``).

    ``max_by`` is partial-aggregated map-side, so an issue with very many
    snapshots costs one row per task in the shuffle. Snapshots without
    version columns (not read by ``read_issues``) carry no order to choose
    by; they are taken as one per id and returned unchanged.
    """
    order = snapshot_order(snapshots)
    if not order:
        return snapshots
    latest = snapshots.groupBy("id").agg(F.max_by(F.struct(*snapshots.columns), F.struct(*order)).alias("_s"))
    return latest.select("_s.*")


def lookup_by_key_or_id(snapshots: DataFrame, wanted: DataFrame,
                        wanted_col: str = "key") -> DataFrame:
    """S3 by id **or** key: snapshots whose id or key equals ``wanted_col``."""
    w = wanted.select(F.col(wanted_col).cast("string").alias("_want")).distinct()
    by_key = snapshots.join(w, snapshots["key"] == w["_want"], "left_semi")
    by_id = snapshots.join(w, snapshots["id"] == w["_want"], "left_semi")
    return by_key.unionByName(by_id).dropDuplicates(["id"])
