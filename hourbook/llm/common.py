"""Helpers shared by the operators: tables in the shared folder, words, positions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourbook.session import checkpoint_dir

# The space and the five ASCII control characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path, never used before, in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its
    lineage ends there, and a lost executor costs nothing that was stored."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """All runs of characters other than ASCII white space; null: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) has this remainder; a null
    doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus) == remainder


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (column names ignore case)."""
    names = {c.lower() for c in df.columns}
    name, i = stem, 0
    while name.lower() in names:
        name, i = f"{stem}_{i}", i + 1
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which Spark doesn't hash, as JSON."""
    cols = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*cols)


def join_spread(rows: DataFrame, totals: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row for each key
    of ``rows`` and in column ``n`` how many rows hold it (dropped).  Both must be
    stored; null keys are equal.

    A key that holds more than one part in P of all rows, P the number of shuffle
    partitions, is hot.  There are fewer than P of these, which bounds their
    broadcast; the rows of all others meet in a shuffle, where none fills a task."""
    spark = rows.sparkSession
    total = totals.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    table = totals.select(*named, *[c for c in totals.columns if c not in keys])

    def same(other: DataFrame) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & rows[k].eqNullSafe(other[f"_{k}"])
        return out

    few, rest = F.broadcast(table.filter(hot)), table.filter(~hot)
    dropped = [f"_{k}" for k in keys] + [n]
    often = rows.join(few, same(few)).drop(*dropped)
    seldom = rows.join(few, same(few), "left_anti")
    return often.unionByName(seldom.join(rest, same(rest)).drop(*dropped))


def positions(df: DataFrame, order: list[Column], size: Column | None = None) -> tuple[DataFrame, int, int]:
    """Number all rows in a total order without a one-task window.

    Rows are range-partitioned and sorted, and each partition's own row
    index is stored with it; bases are prefix sums over the partitions
    (one row per partition, so their number is bounded by the shuffle
    setting).  Rows that are equal in ``order`` are spread by an arbitrary
    last key, so a hot value does not fill one partition.

    Returns (df with ``_row`` from 0 and ``_before`` the sum of ``size`` over
    all earlier rows, number of rows, total size).  ``df`` must be thin and
    must not hold columns with these names or ``_part``, ``_idx``, ``_size``,
    ``_tie``.  Equal rows get different numbers in no defined order.
    """
    spark = df.sparkSession
    sized = df.withColumn("_size", F.lit(0).cast("long") if size is None else size.cast("long"))
    mid = F.monotonically_increasing_id()
    # Order keys become columns, so range bounds and sort use the same values.
    ranged = sized.withColumn("_tie", mid).repartitionByRange(*order, F.col("_tie"))
    laid = stored(
        ranged.sortWithinPartitions(*order, F.col("_tie")).drop("_tie").withColumn("_idx", mid),
        "positions",
    ).withColumn("_part", F.shiftright("_idx", 33))
    sums = sorted(
        (r["_part"], r["n"], r["s"])
        for r in laid.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_size").alias("s")).collect()
    )
    bases, rows, total = [], 0, 0
    for part, n, s in sums:
        bases.append((part, rows, total))
        rows, total = rows + n, total + s
    table = spark.createDataFrame(bases, "_part long, _row0 long, _size0 long")
    out = laid.join(F.broadcast(table), "_part")
    if size is None:
        before = F.lit(0).cast("long")
    else:
        earlier = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_size0") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    return (
        out.withColumn("_before", before)
        .withColumn("_row", F.col("_row0") + F.col("_idx").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_idx", "_size", "_row0", "_size0"),
        rows,
        total,
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows_per_class`` labelled rows of each class
    that ``docs`` holds, chosen by a hash of the id, in a fixed order.  Texts
    over ``max_bytes`` are left out; a class that has no others gives a window
    of at most ``max_bytes`` of each, at a place that the hash picks.  The ids
    are chosen on thin rows, so no text is shuffled, and both bounds limit
    what reaches the driver."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fits = F.octet_length("_text") <= max_bytes
    lengths = texts.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.max(fits).alias("_short"))
    held = stored(known.join(lengths, "_id"), "labelled")
    rows = []
    for value in (0, 1):
        own = held.filter(F.col("_label") == value)
        short = own.filter("_short")
        chosen = (own if short.isEmpty() else short).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class)
        found = texts.join(F.broadcast(chosen), "_id").filter(fits | ~F.col("_short"))
        # A character has four bytes at most.
        width = max_bytes // 4
        place = F.pmod(F.xxhash64("_id"), F.greatest(F.length("_text") - width, F.lit(0)) + 1) + 1
        text = F.when(fits, F.col("_text")).otherwise(F.substring(F.col("_text"), place.cast("int"), F.lit(width)))
        rows += [(r["_id"], r["_text"], value) for r in found.select("_id", text.alias("_text")).collect()]
    return [(text, value) for _, text, value in sorted(rows)]
