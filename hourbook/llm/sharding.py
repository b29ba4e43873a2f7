"""Reproducible shuffle into shards (Feistel permutation of row numbers).

Every row gets a global number in the order of (id, checksum, size).  The
permutation of 0..n-1 sends it to a place p; ``p mod shards`` is the shard and
``p div shards`` the slot.  So shard sizes differ by one row at most, slots
have no gaps, and where a row goes can be computed from its number alone.

Defined results: a null text has size 1 and the checksum of the empty text;
null ids come first; equal rows get different places; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import positions
from hourbook.llm.feistel import permute, walk_steps


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null: the law ``rows`` promises nothing about one more
    shard) and row_number, the document's global number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    numbered, rows, _ = positions(thin, order)
    domains = docs.sparkSession.range(1).select(F.lit(rows).cast("long").alias("_n"), F.lit(0).cast("long").alias("_key"))
    steps = walk_steps(domains, seed) if rows else 0
    placed = permute(
        numbered.withColumn("_n", F.lit(rows).cast("long")).withColumn("_key", F.lit(0).cast("long")), "_row", "_place", seed, steps
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_row").alias("row_number"),
    )
