"""Vector code compression (product codes by slice-and-intersect bitmasks).

Vectors become integers, are cut into equal parts, and each part is replaced by
the number of its nearest codebook entry.  The search for it is exact and mostly
looks at a few of the (at most 64) entries:

- per dimension the entries' coordinates are sorted, and place i carries a
  64-bit mask of the first i entries;
- a radius around a coordinate selects a range of places, and the masks at its
  two ends give the entries inside (their exclusive or);
- the masks of all dimensions, ANDed, are the entries in the box around the
  part.  Each is measured.  An entry outside the box is farther than the radius,
  so the nearest inside is the answer if it is not; else the radius
  grows, to the distance found or to twice its size.

The first radius of a codebook is the median distance from an entry to the next
other one.  Books are trained on all rows in rounds: tasks add up their
parts per entry (a fixed number of sums), Spark adds those, and the driver gets
one sum per entry and dimension.

Defined results: rows whose vector is null, holds null or non-finite components,
or components beyond +-524,288 (their squared distances would not fit 64 bits),
or has another length than most vectors (ties: the shorter) are left out, and so
are empty vectors; a length that the number of parts doesn't divide raises; null
ids stay and come last where the first entries are chosen, repeated ids in the
order of their vectors; with fewer rows than entries the books are smaller; an
empty table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import join_spread, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Squares of differences of 64 such components add up to 2^62 at most.
LARGEST = (1 << 27) // SCALE


def integers(flat: np.ndarray, dims: int) -> np.ndarray:
    """Components as integers: floor(SCALE * x)."""
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, dims)


def masks_of(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per dimension: the sorted coordinates, and at place i the mask of the
    first i entries in that order."""
    out = []
    for column in entries.T:
        order = np.argsort(column, kind="stable")
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        out.append((column[order], np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bits)])))
    return out


def first_radius(entries: np.ndarray) -> int:
    """The median distance from an entry to the nearest other one, rounded up."""
    if len(entries) < 2:
        return 1
    apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    return int(np.sqrt(float(np.median(apart.min(1))))) + 1


def _measured(entries: np.ndarray, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the masked entries and its squared distance (none: the
    largest number).  Bits are taken from the lowest, so ties go to the lower index."""
    best, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    at = np.flatnonzero(masks)
    left = masks[at]
    while len(at):
        lowest = left & (~left + np.uint64(1))
        entry = np.frexp(lowest.astype(np.float64))[1].astype(np.int64) - 1
        distance = ((parts[at] - entries[entry]) ** 2).sum(1)
        nearer = distance < least[at]
        best[at[nearer]], least[at[nearer]] = entry[nearer], distance[nearer]
        left = left & (left - np.uint64(1))
        more = left != 0
        at, left = at[more], left[more]
    return best, least


def nearest(entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest entry and its squared distance."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    slices, todo = masks_of(entries), np.arange(len(parts))
    radius = np.full(len(parts), first_radius(entries), np.int64)
    while len(todo):
        own, reach = parts[todo], radius[todo]
        masks = np.full(len(todo), ~np.uint64(0))
        for d, (coordinates, prefix) in enumerate(slices):
            low = np.searchsorted(coordinates, own[:, d] - reach, "left")
            high = np.searchsorted(coordinates, own[:, d] + reach, "right")
            masks &= prefix[high] ^ prefix[low]
        best, least = _measured(entries, own, masks)
        sure = least <= reach * reach
        index[todo[sure]], error[todo[sure]] = best[sure], least[sure]
        found = np.sqrt(np.where(masks == 0, 0, least).astype(np.float64)).astype(np.int64) + 1
        radius[todo] = np.where(masks == 0, 2 * reach, np.maximum(found, reach + 1))
        todo = todo[~sure]
    return index, error


@dataclass(frozen=True)
class Codebooks:
    """entries[p]: the entries of part p, one row each; ``dims`` components a vector."""

    entries: np.ndarray
    dims: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, the rows' parts, entry, squared distance) for each part position."""
        width = self.dims // len(self.entries)
        for p, book in enumerate(self.entries):
            own = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
            yield p, own, *nearest(book, own)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def usable(vector: Column) -> Column:
    """No component is null, not finite or too large (null vectors: false)."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))
    return F.coalesce(fits, F.lit(False)) & (F.size(vector) > 0)


def kept_rows(rows: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector of the usual length, and that length (0: none)."""
    vector = F.col(vector_col)
    good = rows.filter(usable(vector))
    usual = good.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims = usual["dims"] if usual else 0
    return good.filter(F.size(vector) == dims), dims


def train(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Books that start as the vectors of the smallest ids and move ``rounds``
    times to the floored mean of the parts nearest to each entry."""
    if entries > 64:
        raise ValueError("a mask holds at most 64 entries")
    if dims % parts:
        raise ValueError(f"{parts} parts don't divide {dims} components")
    vector = F.col(vector_col).alias("vector")
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(vector).collect()
    whole = integers(np.array([r["vector"] for r in first], np.float64).ravel(), dims)
    books = Codebooks(whole.reshape(len(first), parts, -1).transpose(1, 0, 2), dims)
    for _ in range(rounds):
        books = _moved(kept.select(vector), books)
    return books


SUM = "part int, entry int, place int, n long, total long"


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.entries.shape, np.int64)
        for batch in batches:
            for p, own, index, _ in books.assign(integers(_flat(batch.column(0)), books.dims)):
                n[p] += np.bincount(index, minlength=entries)
                for d in range(width):
                    # A batch's sums stay far below 2^53.
                    total[p, :, d] += np.bincount(index, own[:, d], entries).astype(np.int64)
        part, entry, place = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        columns = [part, entry, place, np.repeat(n.ravel(), width), total.ravel()]
        used = columns[3] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["part", "entry", "place", "n", "total"])

    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    sums = vectors.mapInArrow(run, SUM).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), exact)
    moved = books.entries.copy()
    for r in sums.collect():  # at most one row per component of the books
        moved[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(moved, books.dims)


def encode(kept: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (the squared
    distances to the entries, added up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(books.entries)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, _, index, error in books.assign(integers(_flat(batch.column(2)), books.dims)):
                codes[:, p] = index
                errors += error
            text, width = codes.tobytes().hex(), 2 * codes.shape[1]
            hexes = pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hexes, pa.array(errors)], ["vec_id", "label", "code", "error"])

    chosen = kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kinds = {c: t for c, t in chosen.dtypes}
    return chosen.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error (error of all rows with an equal
    label, nulls together) and codebooks_sha256."""
    kept, dims = kept_rows(rows, vector_col)
    books = train(kept, dims, parts, entries, rounds, id_col, vector_col) if dims else Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    coded = stored(encode(kept, books, id_col, vector_col, label_col), "codes")
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    joined = join_spread(coded, totals, ["label"], "n")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
