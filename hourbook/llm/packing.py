"""Packing documents into sequences: patterns fitted by non-negative least squares.

Documents are encoded and cut into pieces of at most ``capacity`` tokens.  Only
the histogram of piece lengths (at most ``capacity`` rows) goes to the driver.
There all patterns of up to ``PATTERN_PIECES`` length classes that fill a
sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and the patterns are laid out with
exact lengths, all but the smallest piece of each.  What is left over, with
those smallest pieces, is the residual: it goes into the exact gaps, longest
first and tightest gap first, and into new sequences.  All of this works on
counts, so it takes as long for a billion documents as for a thousand.

The plan says for each length which run of its pieces, numbered in order, goes
to which run of sequences at which offset.  It has a row per run (bounded by
the patterns and lengths, not by the documents) and is broadcast; pieces get
their numbers from range partitions.  No piece moves to the driver.

Defined results: a null or empty text is one piece holding the end id alone;
equal rows are separate documents; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourbook.llm.common import positions, stored
from hourbook.llm.encoding import slices, worker_encoder

CAPACITY = 4096
CLASSES = 128
PATTERN_PIECES = 4
NNLS_ROUNDS = 600

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, cut: str | None, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece; ``with_ids`` adds ids, little-endian unsigned 32-bit
    integers as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = worker_encoder(tokenizer_path, cut, end_id), 4 * capacity
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    for i in range(0, len(ids), size):
                        own = ids[i : i + size]
                        rows.append((doc, i // size, i // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names if with_ids else names[:5])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def fit_patterns(matrix: np.ndarray, counts: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    x, used = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    for _ in range(rounds):
        slope = matrix.T @ (counts - matrix @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-6 * max(1.0, counts.max()):
            break
        used[best] = True
        while used.any():
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(matrix[:, at], counts, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            drop = at[(x[at] <= 1e-9) & low]
            drop = drop if len(drop) else at[low][:1]
            x[drop], used[drop] = 0, False
    return x


def _patterns(classes: list[int], total: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` of the classes that add up to ``total``."""
    known, out = set(classes), []

    def grow(prefix: tuple[int, ...], left: int, largest: int) -> None:
        if left <= largest and left in known:
            out.append((*prefix, left))
        if len(prefix) + 1 < most:
            for c in classes:
                if c > largest or c >= left:
                    break
                if c * (most - len(prefix)) >= left:
                    grow((*prefix, c), left - c, c)

    grow((), total, total)
    return out


Groups = list[tuple[int, tuple[int, ...]]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Groups:
    """(number of sequences, lengths in them) that use up the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    width = -(-capacity // CLASSES)
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        by_class.setdefault(-(-n // width), []).append(n)  # the longest is taken first
    classes = sorted(by_class)
    open_: dict[int, Groups] = {}
    patterns = [p for p in _patterns(classes, capacity // width, PATTERN_PIECES) if len(p) > 1]
    if patterns:
        row = {c: i for i, c in enumerate(classes)}
        matrix = np.zeros((len(classes), len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                matrix[row[c], j] += 1
        counts = np.array([float(sum(left[n] for n in by_class[c])) for c in classes])
        repeats = np.floor(fit_patterns(matrix, counts)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            # All but the smallest piece are fixed now, with exact lengths.
            todo = int(repeats[j])
            while todo:
                lengths, n = [], todo
                for c in patterns[j][:-1]:
                    if not by_class[c]:
                        n = 0
                        break
                    lengths.append(by_class[c][-1])
                for length in set(lengths):
                    n = min(n, left[length] // lengths.count(length))
                if not n and lengths and len(lengths) == len(patterns[j]) - 1:
                    # One length is needed twice and is there once: leave it to the residual.
                    break
                if not n:
                    break
                for length in lengths:
                    left[length] -= n
                for c in set(patterns[j][:-1]):
                    while by_class[c] and not left[by_class[c][-1]]:
                        by_class[c].pop()
                open_.setdefault(capacity - sum(lengths), []).append((n, tuple(lengths)))
                todo -= n
    gaps = sorted(open_)

    def put(gap: int, group: tuple[int, tuple[int, ...]]) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append(group)

    for length in sorted((n for n in left if left[n]), reverse=True):
        todo = left[length]
        while todo:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                n, held = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(i)
            else:
                gap, n, held = capacity, todo, ()
            each = min(gap // length, todo)
            full = min(n, todo // each)
            put(gap - each * length, (full, held + (length,) * each))
            if n > full and (held or gap < capacity):
                put(gap, (n - full, held))
            todo -= full * each
    return [g for gap in sorted(open_) for g in open_[gap]]


def plan_rows(groups: Groups, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, end, first_sequence, offset): the pieces of this length
    numbered first..end-1 over all pieces in length order."""
    at, total = {}, 0
    for n in sorted(histogram):
        at[n], total = total, total + histogram[n]
    out, sequence = [], 0
    for n, lengths in groups:
        offset = 0
        for length in lengths:
            out.append((length, at[length], at[length] + n, sequence, offset))
            at[length] += n
            offset += length
        sequence += n
    return out


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (PIECE columns, stored) -> also sequence_id and offset."""
    spark = table.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_rows(plan(histogram, capacity), histogram)
    runs = spark.createDataFrame(rows, "_length long, _first long, _end long, _sequence long, offset long")
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    numbered, _, _ = positions(table.select("doc_id", "piece", "start", "length", "ids_crc32"), order)
    fits = (F.col("length") == F.col("_length")) & (F.col("_row") >= F.col("_first")) & (F.col("_row") < F.col("_end"))
    placed = numbered.join(F.broadcast(runs), fits)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_row") - F.col("_first")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, cut: str | None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer_path, end_id, cut, capacity, **columns), "pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int, cut: str | None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (binary) and
    parts (offset, length, doc_id, piece).  A group holds one sequence, at most
    ``capacity`` tokens."""
    table = stored(pieces(docs, tokenizer_path, end_id, cut, capacity, with_ids=True, **columns), "pieces")
    placed = pack(table, capacity)
    # Equal pieces (same document, piece and ids) are told apart by number.
    number = F.row_number().over(Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("length"))
    left = placed.withColumn("copy", number)
    right = table.select("doc_id", "piece", "ids_crc32", "length", "ids").withColumn("copy", number)
    same = left["doc_id"].eqNullSafe(right["doc_id"])
    for c in ("piece", "ids_crc32", "copy"):
        same = same & (left[c] == right[c])
    joined = left.join(right, same).select(left["sequence_id"], left["offset"], left["length"], left["doc_id"], left["piece"], "ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    grouped = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("all"))
    return grouped.select(
        "sequence_id",
        "n_tokens",
        F.aggregate(F.transform("all", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.transform("all", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece"))).alias("parts"),
    )
