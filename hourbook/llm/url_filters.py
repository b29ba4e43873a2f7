"""URL filters (sort-merge range join over reversed-host keys).

A rule is a host, a path and a verdict.  It fits its host and all subdomains,
where the url's path starts with the rule's.  Hosts written label by label from
the right, each with a full stop after it (``org.example.``), turn "this host and
its subdomains" into a prefix, and a prefix into an interval of the sorted keys.
A rule's path is a prefix as well, but subdomains lie between its host and its
path, so there are two sweeps over sorted keys:

1. reversed hosts of all urls against the reversed hosts that have rules: each
   url gets the rule hosts it lies in, no more than its host has labels;
2. (rule host, path of the url) against (rule host, path of the rule).

In a sweep, keys and interval starts are sorted together.  Prefix intervals
either nest or don't meet, so the rules that are open at a key are a stack: the
last start at or before the key, with the starts around it.  Each start
carries that stack; a key takes the stack of the last start before it and drops
the intervals that have ended, which are those that are not its prefix.  Sorted
rows are dealt by range with the row as the last sort key, so a host or a url
that a third of all rows hold is spread over many tasks.  No url meets a rule
outside its own stack, and no rule is broadcast.

Of several rules that fit the longest wins (host and path together, then the
host); of equal rules with different verdicts ``block`` does.

Defined results: host and path of a null url, or one without ``://``, are empty;
an empty host or path fits only rules that are empty there; rules with a null
host or verdict are left out, a null path is the empty one; without rules or
without a fitting one the rule is null and the verdict is ``default``; equal rows
stay, one result each; null ids stay; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourbook.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``: subdomains extend it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_stacks(starts: DataFrame) -> DataFrame:
    """``starts`` (key, value; keys unique) -> also stack: (key, value) of
    each start that is a prefix of the key, itself included, the longest first.  A
    key is looked up by each of its prefixes, so a stack is never longer than
    its key."""
    prefixes = starts.select("key", F.explode(F.expr("sequence(1, length(key))")).alias("n"))
    prefixes = prefixes.select("key", F.expr("substring(key, 1, n)").alias("prefix"))
    inner = starts.select(F.col("key").alias("prefix"), F.col("value").alias("around"))
    entry = F.struct(F.length("prefix").alias("n"), F.col("prefix").alias("key"), F.col("around").alias("value"))
    found = prefixes.join(inner, "prefix").groupBy("key").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    return found.select("key", F.transform("stack", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("stack"))


def sweep(points: DataFrame, starts: DataFrame) -> DataFrame:
    """``points`` (key and other columns) -> also open: the (key, value) of all
    ``starts`` whose key is a prefix of the point's, the longest first.

    Points and starts are sorted together and dealt by range; the stack that
    is open where a range begins is the one of the last start before it,
    one row a range."""
    spark = points.sparkSession
    others = [c for c in points.columns if c != "key"]
    row = F.monotonically_increasing_id()
    stacks = with_stacks(starts)
    thin = points.select("key", F.struct(*others).alias("point"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    nothing = F.lit(None).cast(thin.schema["point"].dataType).alias("point")
    both = thin.unionByName(stacks.select("key", nothing, "stack"))
    # A start comes before the points of its key.
    order = [F.col("key"), F.col("stack").isNull(), F.col("tie")]
    ranged = both.withColumn("tie", row).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    laid = stored(ranged.withColumn("idx", row), "sweep").withColumn("part", F.shiftright("idx", 33))
    ranges = laid.groupBy("part").agg(F.max(F.when(F.col("stack").isNotNull(), F.col("idx"))).alias("idx"))
    last = ranges.join(laid.filter("stack is not null").select("idx", F.col("stack").alias("own")), "idx", "left")
    # One row a range, as many as the session's shuffles have partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("own", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = laid.join(F.broadcast(carried), "part").withColumn("here", F.last("stack", ignorenulls=True).over(so_far))
    stack = F.coalesce("here", "carried", F.array().cast(stacks.schema["stack"].dataType))
    open_ = F.filter(stack, lambda e: F.startswith(F.col("key"), e["key"]))
    return swept.filter("stack is null").select("key", "point.*", open_.alias("open"))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict -> one row per rule: host, path, rule, verdict."""
    wrong = rules.filter(~F.col("verdict").isin(*VERDICTS)).select("verdict").first()
    if wrong is not None:
        raise ValueError(f"a verdict is allow or block, not {wrong['verdict']!r}")
    known = rules.filter("host is not null and verdict is not null")
    named = known.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return named.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the one
    that decides, else null) and verdict.  ``rules``: host, path, verdict."""
    rules = stored(canonical_rules(rules), "rules")
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    hosts = rules.select(reversed_host(F.col("host")).alias("key"), "host").groupBy("key").agg(F.max("host").alias("value"))
    in_hosts = sweep(urls.withColumn("key", reversed_host(F.col("host"))), hosts)
    row = F.monotonically_increasing_id()
    probes = stored(in_hosts.select("page_id", "host", "path", F.transform("open", lambda e: e["key"]).alias("near")).withColumn("row", row), "hosts")
    # No slash is in a host, so the first one ends it in keys as well.
    probe = probes.withColumn("near", F.explode("near")).select("row", F.concat("near", F.lit("/"), "path").alias("key"))
    value = F.struct(F.length("rule").alias("chars"), F.length("host").alias("host_chars"), "rule", "verdict")
    paths = rules.select(F.concat(reversed_host(F.col("host")), F.lit("/"), "path").alias("key"), value.alias("value"))
    found = sweep(probe, paths).select("row", F.get("open", F.lit(0))["value"].alias("value")).filter("value is not null")
    best = found.groupBy("row").agg(F.max("value").alias("value"))
    return probes.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("value.rule").alias("rule"), F.coalesce("value.verdict", F.lit(default)).alias("verdict")
    )
