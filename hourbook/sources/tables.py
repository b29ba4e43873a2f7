"""Parquet table access (S4, S5) and the loader for the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from hourbook.functions.schemas import ISSUE_COLUMNS, WORKLOG_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scan_worklogs(worklog: DataFrame) -> DataFrame:
    """Full scan of ``worklog`` with the canonical columns."""
    return worklog.select(*WORKLOG_COLUMNS)


def scan_issues(issue: DataFrame) -> DataFrame:
    """Full scan of ``issue``; all columns, updateDate included."""
    return issue.select(*ISSUE_COLUMNS)
