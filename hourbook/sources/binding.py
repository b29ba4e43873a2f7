"""Binding of the driver's TPC-H-style tables to the tracker data model.

The driver's tables hold no tracker data, so the two canonical tables and
the raw tracker exports are *derived* from them with joins and
aggregations (all on Spark, all growing with the input):

worklog  one row per ``lineitem``: author = supplier name, date = ship date,
         time spent = 600 s per unit of quantity, issue = the order.
issue    one row per ``orders``: resolved iff status 'F', updated at the
         last ship date, developer = supplier of the latest line.
raw      the same facts shaped like the tracker's JSON exports (change
         feed, worklog entries, issue snapshots with sub-task parents), so
         the ingest operators run on them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourbook.functions import exprs as X
from hourbook.functions.schemas import ISSUE_COLUMNS, WORKLOG_COLUMNS
from hourbook.sources.tables import read_table

# Fixed values of the binding.
SECONDS_PER_QUANTITY = 600          # time spent per unit of l_quantity
ESTIMATE_DIVISOR = 10               # estimate seconds = o_totalprice / 10
RESOLVED_STATUS = "F"               # order status that marks an issue resolved
# Offset written into the raw tracker timestamps: midnight wall clock is
# 22:00 UTC of the previous day, so wall clock and instant fall on different
# days and every day/week rule is checked against the wall clock.
RAW_OFFSET = "+0200"


# Dimension tables each canonical column needs beyond lineitem + orders
# (worklog) or orders + per-order line aggregate (issue). A query asks only
# for its columns, so joins whose columns it never reads are not planned:
# Catalyst cannot drop a left join itself, as it does not know the
# dimension keys are unique.
WORKLOG_NEEDS = {
    "author": {"supplier"},
    "project": {"customer", "nation"},
    "issueKey": {"customer", "nation"},
    "parentIssueKey": {"customer", "nation"},
    "issueType": {"customer"},
    "parentIssueType": {"customer"},
}
ISSUE_NEEDS = {
    "developer": {"supplier"},
    "key": {"customer", "nation"},
    "project": {"customer", "nation"},
    "type": {"customer"},
}


def _needs(table: dict, columns) -> set:
    out = set()
    for c in columns:
        out |= table.get(c, set())
    if "nation" in out:
        out.add("customer")
    return out


def _orders_enriched(spark: SparkSession, sf_dir: str, need: set | None = None) -> DataFrame:
    """orders + customer segment + customer nation name (as needed)."""
    need = {"customer", "nation"} if need is None else need
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    if "customer" not in need:
        return orders
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    out = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    if "nation" not in need:
        return out
    # nation is the fixed 25-row TPC-H dimension: a proven size bound.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name"))
    return out.join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")


def _issue_key(project_col, id_col):
    return F.concat_ws("-", project_col, id_col.cast("string"))


def bound_worklog(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """``worklog`` table derived from lineitem/orders/customer/nation/supplier;
    ``columns`` limits the output (and the joins) to what a query reads."""
    cols = list(WORKLOG_COLUMNS) if columns is None else \
        [c for c in WORKLOG_COLUMNS if c in set(columns)]
    need = _needs(WORKLOG_NEEDS, cols)
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    joined = li
    if "supplier" in need:
        supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        joined = joined.join(supplier, li.l_suppkey == supplier.s_suppkey, "left")
    orders = _orders_enriched(spark, sf_dir, need)
    joined = joined.join(orders, F.col("l_orderkey") == orders.o_orderkey, "inner")
    seconds = (F.col("l_quantity") * SECONDS_PER_QUANTITY).cast("int")
    summary = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    exprs = {
        "id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "author": F.col("s_name"),
        "date": F.col("l_shipdate"),
        "started_at": X.ntz_to_instant("l_shipdate"),
        "weekNumber": X.iso_week("l_shipdate"),
        "weekDay": X.weekday_name("l_shipdate"),
        "timeSpentSeconds": seconds,
        "timeSpentHours": X.seconds_to_hours(seconds),
        "project": F.col("n_name"),
        "issueId": F.col("l_orderkey"),
        "issueKey": _issue_key(F.col("n_name"), F.col("l_orderkey")),
        "issueType": F.col("c_mktsegment"),
        "issueSummary": summary,
        "issuePriority": F.col("o_orderpriority"),
        "issueStatus": F.col("o_orderstatus"),
        "parentIssueId": F.col("l_orderkey"),
        "parentIssueKey": _issue_key(F.col("n_name"), F.col("l_orderkey")),
        "parentIssueType": F.col("c_mktsegment"),
        "parentIssueSummary": summary,
        "parentIssuePriority": F.col("o_orderpriority"),
        "parentIssueStatus": F.col("o_orderstatus"),
    }
    return joined.select(*[exprs[c].alias(c) for c in cols])


def _lines_per_order(spark: SparkSession, sf_dir: str, with_developer: bool = True) -> DataFrame:
    """Per order: last ship date, total quantity, supplier of the latest line.

    Aggregated *before* the supplier join, so the join sees one row per
    order instead of one per line; max_by is partial-aggregated map-side.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    aggs = [F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("qty")]
    if with_developer:
        aggs.append(F.max_by("l_suppkey", F.struct("l_shipdate", "l_linenumber", "l_suppkey"))
                    .alias("last_suppkey"))
    per_order = li.groupBy("l_orderkey").agg(*aggs)
    if not with_developer:
        return per_order
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return per_order.join(supplier, per_order.last_suppkey == supplier.s_suppkey, "left")


def bound_issue(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """``issue`` table: one row per order (orders without lines included);
    ``columns`` limits the output (and the joins) to what a query reads."""
    cols = list(ISSUE_COLUMNS) if columns is None else \
        [c for c in ISSUE_COLUMNS if c in set(columns)]
    need = _needs(ISSUE_NEEDS, cols)
    orders = _orders_enriched(spark, sf_dir, need)
    lines = _lines_per_order(spark, sf_dir, with_developer="supplier" in need)
    j = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    resolved = F.col("o_orderstatus") == RESOLVED_STATUS
    update = F.coalesce(F.col("last_ship"), F.col("o_orderdate"))
    created_at = X.ntz_to_instant("o_orderdate")
    exprs = {
        "id": F.col("o_orderkey"),
        "key": _issue_key(F.col("n_name"), F.col("o_orderkey")),
        "type": F.col("c_mktsegment"),
        "summary": F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
        "priority": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"),
        "createDate": F.col("o_orderdate"),
        "created_at": created_at,
        "updateDate": update,
        "resolvedDate": F.when(resolved, update),
        "isResolved": resolved,
        "daysToResolve": F.when(resolved, X.days_between_ceil(created_at, X.ntz_to_instant(update)))
        .otherwise(F.lit(0)),
        "aggregateTimeSpent": X.zero_if_null((F.col("qty") * SECONDS_PER_QUANTITY).cast("int")),
        "aggregateTimeOriginalEstimate": (F.col("o_totalprice") / ESTIMATE_DIVISOR).cast("int"),
        "project": F.col("n_name"),
        "developer": F.col("s_name"),
    }
    return j.select(*[exprs[c].alias(c) for c in cols])


# --- raw tracker exports derived from the same tables --------------------------
def _tracker_text(ntz_col, extra_ms=None):
    """Tracker timestamp text of a wall clock, with the fixed RAW_OFFSET."""
    ts = ntz_col.cast("timestamp")
    if extra_ms is not None:
        ts = F.timestamp_millis(F.unix_millis(ts) + extra_ms)
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(RAW_OFFSET))


def _versioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows with worklog id and a version number within the id.

    (l_orderkey, l_linenumber) repeats; the repeats are successive versions
    of one worklog, ordered by (ship date, part, supplier, price), which is
    unique. ``_version`` milliseconds are added to the update time, so
    versions of an id never tie and never cross days.
    """
    from pyspark.sql import Window
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate")
    wid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    w = Window.partitionBy("_wid").orderBy("l_shipdate", "l_partkey", "l_suppkey",
                                           "l_extendedprice")
    return li.withColumn("_wid", wid).withColumn("_version", F.row_number().over(w))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed rows (already flattened): one per worklog version."""
    lines = _versioned_lines(spark, sf_dir)
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("_version") \
        - F.lit(_offset_ms())
    return lines.select(
        F.col("_wid").alias("worklogId"),
        ms.alias("updatedTime"),
        X.millis_to_ts(ms).alias("updated_at"),
        F.array().cast("array<string>").alias("properties"),
        F.col("_version"))


def _offset_ms() -> int:
    sign = -1 if RAW_OFFSET.startswith("-") else 1
    return sign * (int(RAW_OFFSET[1:3]) * 60 + int(RAW_OFFSET[3:5])) * 60_000


def raw_worklogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worklog entries shaped like the tracker's JSON (schema RAW_WORKLOG)."""
    lines = _versioned_lines(spark, sf_dir)
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey, "left")
    seconds = (F.col("l_quantity") * SECONDS_PER_QUANTITY).cast("int")
    started = _tracker_text(F.col("l_shipdate"))
    updated = _tracker_text(F.col("l_shipdate"), F.col("_version"))
    author = F.struct(
        F.lit(None).cast("string").alias("self"),
        F.col("l_suppkey").cast("string").alias("accountId"),
        F.col("s_name").alias("displayName"),
        F.lit(True).alias("active"),
        F.lit("UTC").alias("timeZone"),
        F.lit("user").alias("accountType"))
    return j.select(
        F.lit(None).cast("string").alias("self"),
        author.alias("author"),
        started.alias("created"),
        updated.alias("updated"),
        started.alias("started"),
        F.concat((seconds / 60).cast("int").cast("string"), F.lit("m")).alias("timeSpent"),
        seconds.alias("timeSpentSeconds"),
        F.col("_wid").cast("string").alias("id"),
        F.col("l_orderkey").cast("string").alias("issueId"))


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue snapshots shaped like the tracker's JSON (schema RAW_ISSUE).

    Sub-tasks: every later order of a customer is a sub-task of the
    customer's first order (one aggregate + join; no window over a
    customer, so a customer with a third of all orders is still split
    across tasks by the partial aggregation).
    """
    # both joins by customer come first, so that orders are moved once for them
    orders = _orders_enriched(spark, sf_dir)
    lines = _lines_per_order(spark, sf_dir, with_developer=False)
    first = (read_table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderkey").alias("first_key"))
             .withColumnRenamed("o_custkey", "f_custkey"))
    j = (orders.join(first, F.col("o_custkey") == F.col("f_custkey"), "left")
         .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))
    resolved = F.col("o_orderstatus") == RESOLVED_STATUS
    change = F.coalesce(F.col("last_ship"), F.col("o_orderdate"))
    is_sub = F.col("first_key").isNotNull() & (F.col("first_key") != F.col("o_orderkey"))
    parent = F.when(is_sub, F.struct(
        F.col("first_key").cast("string").alias("id"),
        _issue_key(F.col("n_name"), F.col("first_key")).alias("key")))
    fields = F.struct(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("summary"),
        _tracker_text(F.col("o_orderdate")).alias("created"),
        F.when(resolved, _tracker_text(change)).alias("resolutiondate"),
        _tracker_text(change).alias("statuscategorychangedate"),
        F.struct(F.col("c_mktsegment").alias("name")).alias("issuetype"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("priority"),
        F.struct(F.col("o_orderstatus").alias("name")).alias("status"),
        parent.alias("parent"),
        (F.col("qty") * SECONDS_PER_QUANTITY).cast("int").alias("aggregatetimespent"),
        (F.col("o_totalprice") / ESTIMATE_DIVISOR).cast("int")
        .alias("aggregatetimeoriginalestimate"))
    return j.select(
        F.col("o_orderkey").cast("string").alias("id"),
        _issue_key(F.col("n_name"), F.col("o_orderkey")).alias("key"),
        fields.alias("fields"))
