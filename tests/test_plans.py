"""Physical-plan properties of the registered queries over the tracker tables: no cartesian or
nested-loop joins, no Python evaluation, range filters pushed to the scan,
and no join to a dimension table the query does not read."""

import glob
import re

import pytest

from conftest import SF_SMALL
from hourbook.plans import stream_queries as SQ
from hourbook.plans.catalog import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")

# Reports whose date range must reach the lineitem scan as a pushed filter.
RANGE_ON_LINEITEM = ("worklogs_group_by_priority", "worklogs_group_by_weekday",
                     "worklogs_per_dev_day", "worklogs_per_dev", "in_date_range",
                     "recent_weeks", "worklogs_per_dev_week", "worklogs_per_weekday")


def plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operators(spark, name):
    p = plan(spark, name)
    for op in FORBIDDEN:
        assert op not in p, f"{name}: {op}"


@pytest.mark.parametrize("name", RANGE_ON_LINEITEM)
def test_range_pushed_to_scan(spark, name):
    p = plan(spark, name)
    scans = [line for line in p.splitlines() if "lineitem.parquet" in line]
    assert scans and all(re.search(r"PushedFilters: \[.*l_shipdate", s) for s in scans), name


def test_report_reads_only_needed_tables(spark):
    p = plan(spark, "worklogs_group_by_weekday")
    assert "supplier.parquet" not in p and "customer.parquet" not in p
    p = plan(spark, "issues_grouped_by_priority")
    assert "supplier.parquet" not in p and "nation.parquet" not in p


def test_column_pruning(spark):
    p = plan(spark, "worklogs_group_by_weekday")
    schema = re.search(r"lineitem\.parquet.*?ReadSchema: (struct<[^>]*>)", p, re.S).group(1)
    assert "l_extendedprice" not in schema and "l_partkey" not in schema


@pytest.mark.parametrize("name", ["upsert_worklogs", "upsert_worklogs_keep_first", "upsert_worklogs_two_batches", "upsert_issues", "upsert_issues_touch"])
def test_upserts_keep_one_row_per_id_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "SortAggregate" not in p and "WindowGroupLimit" in p


def _windows(node):
    children = node.children()
    found = [w for i in range(children.size()) for w in _windows(children.apply(i))]
    return found + [node] if node.nodeName() == "Window" else found


@pytest.mark.parametrize("name", ["upsert_worklogs", "upsert_worklogs_keep_first", "upsert_worklogs_two_batches", "upsert_issues", "upsert_issues_touch"])
def test_upserts_choose_among_rows_without_issue_texts(spark, name):
    """Rows are moved by id before their issue is looked up, not after."""
    found = _windows(QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan())
    moved = [{w.output().apply(i).name() for i in range(w.output().size())} for w in found]
    assert moved and not any(names & {"issueSummary", "parentIssueKey", "summary", "key"} for names in moved)


def test_one_pass_reports(spark):
    """J4 and A7 read and aggregate their table once."""
    for name, table in (("developer_day_grid", "lineitem.parquet"), ("worklogs_per_dev_week_with_average", "lineitem.parquet")):
        assert plan(spark, name).count(table) == plan(spark, name.replace("developer_day_grid", "worklogs_per_dev_day").replace("_with_average", "")).count(table), name


def test_user_table_runs_no_job_while_the_plan_is_built(spark):
    from hourbook.operators import filters as FL

    names = spark.range(1).selectExpr("raise_error('ran') AS name")
    assert FL.filter_users(spark.range(3).selectExpr("'a' AS author"), names).columns == ["author"]


@pytest.mark.parametrize("name", ["worklogs_per_weekday", "worklogs_per_dev_weekday"])
def test_last_week_opens_its_months_only(spark, scratch, name):
    import datetime as dt
    import os

    from hourbook.operators import aggregates as A

    path = os.path.join(scratch, "worklog")
    days = spark.sql("SELECT id, 'a' AS author, cast(date_add(DATE'1996-01-01', id) AS timestamp_ntz) AS date, 1.0D AS timeSpentHours, "
                     "date_format(date_add(DATE'1996-01-01', id), 'EEEE') AS weekDay, date_format(date_add(DATE'1996-01-01', id), 'yyyy-MM') AS month "
                     "FROM (SELECT cast(id AS int) AS id FROM range(400))")
    days.write.partitionBy("month").parquet(path)
    report = getattr(A, name)(spark.read.parquet(path), dt.datetime(1996, 6, 20))
    p = report._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", p)


@pytest.mark.parametrize("name", ("read_landed_details", "read_landed_issues"))
def test_landed_exports_are_compressed(spark, name):
    """What a query lands is a fraction of its JSON text."""
    files = QUERIES[name](spark, SF_SMALL).inputFiles()
    landed = [f for f in files if "hourbook-stream" in f]
    assert landed and all(f.endswith(".json.gz") for f in landed)


def test_latest_snapshots_move_shown_fields_only(spark):
    p = QUERIES["read_landed_issues"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    picked = [line for line in p.splitlines() if "max_by" in line]
    assert picked and not any("summary" in line.split("max_by", 1)[1] for line in picked)


@pytest.mark.parametrize("run", (SQ.run_gaps, SQ.run_refresh_gaps))
def test_exports_with_gaps_are_compressed(spark, monkeypatch, run):
    class Landed(Exception):
        pass

    def landed(spark, land, *args, **kw):
        raise Landed(land)

    monkeypatch.setattr(SQ, "stream_worklogs", landed)
    with pytest.raises(Landed) as stopped:
        run(spark, SF_SMALL)
    for kind in ("worklogs", "issues"):
        files = glob.glob(f"{stopped.value}/{kind}/part-*")
        assert files and all(f.endswith(".gz") for f in files)


@pytest.mark.parametrize("refresh", (False, True))
def test_streams_land_compressed_files_for_every_core(spark, monkeypatch, refresh):
    """All cores write and read each micro-batch, and there are three of them."""
    class Landed(Exception):
        pass

    def landed(spark, land, *args, **kw):
        raise Landed(land, kw.get("max_files_per_trigger"))

    monkeypatch.setattr(SQ, "stream_worklogs", landed)
    monkeypatch.setattr(SQ, "refresh_resolutions", lambda *args: None)
    with pytest.raises(Landed) as stopped:
        SQ.run_streams(spark, SF_SMALL, refresh)
    land, at_once = stopped.value.args
    assert at_once == spark.sparkContext.defaultParallelism
    for kind in ("worklogs", "issues"):
        files = glob.glob(f"{land}/{kind}/part-*")
        assert all(f.endswith(".gz") for f in files) and len(files) == SQ.MICRO_BATCHES * at_once
    assert len(glob.glob(f"{land}/feed/part-*.gz")) >= min(SQ.MICRO_BATCHES, at_once)
