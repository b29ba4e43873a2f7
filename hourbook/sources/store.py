"""The stored tables: plain Parquet partitions and one pointer (K1-K5 writes).

Parquet has no upsert and Spark cannot overwrite a path it reads, so a commit
writes the new content of the partitions it touched beside the old ones,

    <root>/<table>/<column>=<value>/run=<run>/part-*.parquet

and then publishes a record that names the run of every partition, together
with the cursor and the last batch of each job. Readers open the partitions
that the newest record names; the others are never copied. Records
are written in turn to two places, so one is always whole: a crash before the
record leaves the store as it was, a replayed batch finds itself in it.

Worklogs are partitioned by month. Tables that are looked up by id are
partitioned by blocks of ids, so a batch opens the blocks of the ids it names.
A store has one writer at a time (``streaming.jobs.run_tracker``).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourbook.functions import schemas as S

IDS_PER_BLOCK = 100_000
MAX_RECORDS_PER_FILE = 5_000_000
# Partition of rows whose partition value is null (entries without a date).
NO_VALUE = "none"
# Tables and work frames are written once and read few times, and disk is what a batch runs out of.
CODEC = {"compression": "zstd"}
# Spark deletes the shuffle files of a query when it ends, not whenever the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind; the session's own setting is restored.
    No frame is handed from one query to another by its shuffle files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)

#: table -> (schema, partition column)
TABLES: dict[str, tuple[T.StructType, str]] = {
    "worklog": (S.WORKLOG_STORED, "month"),
    "issue": (S.ISSUE_STORED, "block"),
    "place": (S.PLACE, "block"),
    "snapshot": (S.SNAPSHOT, "block"),
    "waiting": (S.WAITING, "part"),
    "wanted": (S.WANTED, "part"),
}


def partition_of(name: str) -> Column:
    """The partition value of a row of table ``name``."""
    column = TABLES[name][1]
    if column == "part":
        return F.lit("all")
    value = F.date_format("date", "yyyy-MM") if column == "month" else F.floor(F.col("id").cast("long") / IDS_PER_BLOCK).cast("string")
    return F.coalesce(value, F.lit(NO_VALUE))


class SnapshotStore:
    """The tables of one deployment under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def latest_commit(self) -> dict | None:
        """The newest record (None: nothing was committed yet)."""
        try:
            rows = self.spark.read.text(f"{self.root}/_pointer").collect()  # two small rows
        except AnalysisException:
            return None
        return max((json.loads(r["value"]) for r in rows if r["value"]), key=lambda c: c["version"], default=None)

    def publish(self, prev: dict | None, record: dict) -> dict:
        """Write ``record`` as the version after ``prev``, the only step that
        readers see. Raises if another writer published since ``prev`` was read."""
        version = 1 + (prev or {}).get("version", 0)
        if ((self.latest_commit() or {}).get("version", 0)) >= version:
            raise RuntimeError(f"version {version} of {self.root} is published already: another job wrote to this store")
        record = {**(prev or {}), **record, "version": version}
        text = self.spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.root}/_pointer/slot={version % 2}")
        return record

    def applied(self, job: str, commit: dict | None) -> int | None:
        """Last batch of ``job`` that is committed (None: never ran)."""
        return (commit or {}).get("jobs", {}).get(job)

    def cursor(self) -> dict | None:
        return (self.latest_commit() or {}).get("cursor")

    def read(self, name: str, commit: dict | None = None, partitions: list[str] | None = None) -> DataFrame | None:
        """Current content of a table, or of the named partitions (None: no
        rows). Only the folders of wanted partitions are listed. Worklogs
        without a date have a partition of their own; their month is null."""
        schema, column = TABLES[name]
        live = ((commit if commit is not None else self.latest_commit()) or {}).get("tables", {}).get(name, {})
        base = f"{self.root}/{name}"
        wanted = set(live if partitions is None else partitions)
        paths = [f"{base}/{column}={p}/run={live[p]}" for p in sorted(live) if p in wanted]
        if not paths:
            return None
        df = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        part = F.nullif(F.col(column).cast("string"), F.lit(NO_VALUE)).alias(column)
        return df.select(*schema.fieldNames(), part)

    def replace(self, name: str, content: DataFrame, touched: list[str], commit: dict | None) -> tuple[dict, int]:
        """Write ``content`` as the new rows of the ``touched`` partitions; return
        the tables as the next record names them, and how many rows were written."""
        schema, column = TABLES[name]
        tables = {k: dict(v) for k, v in (commit or {}).get("tables", {}).items()}
        live, run, base = tables.setdefault(name, {}), uuid.uuid4().hex, f"{self.root}/{name}"
        out = content.select(*schema.fieldNames(), partition_of(name).alias(column), F.lit(run).alias("run"))
        # AQE gathers small partitions in one task and splits large ones.
        writer = out.where(F.col(column).isin(touched)).hint("rebalance", column).write.mode("append")
        writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(column, "run").parquet(base, **CODEC)
        for p in touched:
            live.pop(p, None)
        try:
            written = self.spark.read.schema(schema).option("basePath", base).parquet(f"{base}/{column}=*/run={run}")
            counts = {str(r[column]): r["count"] for r in written.select(F.col(column).cast("string")).groupBy(column).count().collect()}
        except AnalysisException:  # no row was left to write
            counts = {}
        live.update(dict.fromkeys(counts, run))
        return tables, sum(counts.values())

    def append(self, name: str, rows: DataFrame, job: str) -> DataFrame:
        """Add rows to a log (``_rejects``); return them as written."""
        path = f"{self.root}/{name}/job={job}/run={uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """K5: a report as JSON lines (one object per row)."""
    df.write.mode("overwrite").json(path)


def default_root(spark: SparkSession, name: str = "hourbook-store") -> str:
    """A store folder under the shared checkpoint folder of the cluster."""
    from hourbook.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), name)
