"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors of up to 64 elements become 64-bit codes (bit i: element i is positive)
and are searched by Hamming distance, ties going to the smaller id.  A longer
vector is an error, as its code would not hold all elements.

Distinct codes are dealt by hash into index blocks of about ``BLOCK_CODES``; each
distinct query code goes to every block, and blocks are searched apart.  A block
cuts its codes into m segments of about log2(n) bits and keeps a table for each.
A search grows the radius of one segment after the other: once segments up to s
were searched at radius r and the others at r - 1, every code within m*r + s is
found (a code that is missed differs by more than that).  A query ends when its
k-th verified distance is covered by this bound, so results are exact.  The
blocks' results are merged by (distance, id).

A code that many rows share is indexed once, with its k + 1 smallest ids; a code
that many queries share is searched once.

Defined results: null vectors are neither searched nor found; null elements
and NaN give bit 0; a query is not its own neighbour, but other rows with the
same vector are; equal rows (same id) count once; fewer than k other rows give
fewer results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourbook.llm.common import stored

BITS = 64
BLOCK_CODES = 1 << 15
QUERIES_AT_ONCE = 128


def sign_code(vector: Column) -> Column:
    """The signed long whose bit i says that element i is positive; raises if
    there are more than 64."""
    bits = F.transform(
        vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    )
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    too_wide = F.concat(F.lit(f"top-k search takes vectors of at most {BITS} elements, not "), F.size(vector).cast("string"))
    return F.when(F.size(vector) > BITS, F.raise_error(too_wide)).otherwise(code)


class BlockIndex:
    """Segment tables of one block: ``codes`` (unsigned) and for each code how
    many ids stand behind it."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = codes, weights
        m = int(np.clip(round(BITS / max(1.0, np.log2(max(2, len(codes))))), 3, 16))
        edges = np.linspace(0, BITS, m + 1).round().astype(int)
        self.shifts, self.widths = edges[:-1], np.diff(edges)
        self.order, self.starts = [], []
        for s in range(m):
            value = self._segment(codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(value, minlength=1 << self.widths[s]))])

    def _segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(self.shifts[s])) & np.uint64((1 << int(self.widths[s])) - 1)).astype(np.int64)

    def _candidates(self, queries: np.ndarray, s: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) pairs whose segments s differ in exactly r bits."""
        width = int(self.widths[s])
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)
        probes = (self._segment(queries, s)[:, None] ^ masks).ravel()
        begin = self.starts[s][probes]
        count = self.starts[s][probes + 1] - begin
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(np.repeat(np.arange(len(queries)), len(masks)), count), self.order[s][at]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) with at least all codes that can be among the
        k nearest ids of each query."""
        m, found = len(self.widths), []
        # How many ids were verified at each distance, and the k-th one's.
        seen = np.zeros((len(queries), BITS + 1), np.int64)
        kth = np.full(len(queries), BITS + 1)
        active = np.arange(len(queries))
        for r in range(int(self.widths.max()) + 1):
            for s in range(m):
                if not len(active):
                    break
                if r <= self.widths[s]:
                    q, c = self._candidates(queries[active], s, r)
                    q = active[q]
                    apart = queries[q] ^ self.codes[c]
                    d = np.bitwise_count(apart).astype(np.int64)
                    near = d <= kth[q]
                    q, c, d, apart = q[near], c[near], d[near], apart[near]
                    # Only where it was met first: no earlier segment within r,
                    # no later one within r - 1.
                    first = np.ones(len(q), bool)
                    for j in range(m):
                        if j != s:
                            first &= np.bitwise_count(self._segment(apart, j)) >= r + (j < s)
                    q, c, d = q[first], c[first], d[first]
                    found.append((q, c, d))
                    np.add.at(seen, (q, d), self.weights[c])
                    full = np.cumsum(seen[active], 1) >= k
                    kth[active] = np.where(full.any(1), full.argmax(1), BITS + 1)
                active = active[kth[active] > m * r + s]
        q, c, d = (np.concatenate(x) for x in zip(*found))
        best = d <= kth[q]
        return q[best], c[best], d[best]


def search_blocks(index: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_code, id, distance): for each query code and block the ids that
    can be among the k nearest.  index: (block, code, ids), queries: (code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, table, ids, offsets = None, [], None, None, None
        for batch in batches:
            blocks_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (blocks_[1:] != blocks_[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if blocks_[a] != block:
                    block, rows, table = blocks_[a], [], None
                if kinds[a] == 0:
                    rows.append(part)
                    continue
                if table is None and rows:
                    held = pa.Table.from_batches(rows).combine_chunks()
                    codes = np.ascontiguousarray(held.column(2).to_numpy()).view(np.uint64)
                    lists = held.column(3).chunk(0)
                    ids, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
                    table, rows = BlockIndex(codes, np.diff(offsets)), []
                if table is None:
                    continue
                asked = np.ascontiguousarray(part.column(2).to_numpy())
                for at in range(0, len(asked), QUERIES_AT_ONCE):
                    own = asked[at : at + QUERIES_AT_ONCE]
                    q, c, d = table.search(own.view(np.uint64), k)
                    n = offsets[c + 1] - offsets[c]
                    places = np.repeat(offsets[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[np.repeat(q, n)]), pa.array(ids[places]), pa.array(np.repeat(d, n).astype(np.int32))],
                        ["query_code", "id", "distance"],
                    )

    none = F.lit(None).cast("array<bigint>")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = queries.select(everywhere.alias("block"), F.lit(1).alias("kind"), "code", none.alias("ids"))
    both = index.select("block", F.lit(0).alias("kind"), "code", "ids").union(asked)
    laid = both.repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return laid.mapInArrow(run, "query_code long, id long, distance int")


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_codes: int = BLOCK_CODES) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance for each row of ``queries``
    against all of ``rows``; both hold the id and vector columns."""

    def coded(df: DataFrame) -> DataFrame:
        chosen = df.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
        return chosen.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col)).alias("code"))

    # The smallest ids of each code; limits by rank are applied before the shuffle too.
    by_code = Window.partitionBy("code").orderBy("id")
    least = coded(rows).distinct().withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= k + 1)
    codes = stored(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-codes")
    blocks = max(1, -(-codes.count() // block_codes))
    index = codes.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)))
    asked = stored(coded(queries).distinct(), "topk-queries")
    found = search_blocks(index, asked.select("code").distinct(), blocks, k + 1)
    nearest = Window.partitionBy("query_code").orderBy("distance", "id")
    best = found.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1)
    lists = best.groupBy("query_code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = asked.select(F.col("id").alias("query_id"), "code").join(lists, F.col("code") == F.col("query_code"))
    out = joined.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
