"""Filter interaction audit (contingency tensor contractions).

Each document gets one bit per filter that it fails.  Spark counts documents per
part and combination of bits, 2^filters cells a part, and the count of the cells
is all that the audit needs: reshaped to one axis of length two per filter
(pass, fail), every figure of every step of every order is a contraction of this
tensor with a selector per axis, (1, 0) for pass, (0, 1) for fail, (1, 1) for
all:

- removed: earlier filters pass, the step's fails, later ones all;
- kept: earlier ones and the step's pass, later ones all;
- redundant: the step's fails, others all, less removed;
- unique fails: the step's fails, all others pass;
- shapley: a filter's removed, added up over all orders.

A document that equals one of a smaller id is found without its text: SHA-256 of
the text and id are counted per row, the least id per digest is a partial
aggregate (copies meet map-side), and a row passes if (digest, id) is among
them, which is a join on a key that no two rows share but repeated ones, which
were counted into one.

Defined results: null texts are empty, null parts the empty string; a null id is
not smaller than any and none is smaller than it, so such a row never fails as a
copy and makes none fail; repeated rows count each, and rows that share the
smallest id all pass as the first; labels of one id are joined by
maximum, null labels and ids without one count as 0; rows of an empty table give
no part and no result.  Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import stored, word_array

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "#$%&*|"
#: Bit of the last filter, which looks at the other rows.
COPY = 1 << 4
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Filters A to D on a whole text: few words, repeated words, capitals, marks."""
    words = word_array(text)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [
        n < 100,
        F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 80,
        capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        F.translate(text, MARKS, "") != text,
    ]


def failure_bits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, bits (bit i set: the document fails filter i) and n, the
    number of rows that agree in all of these and in the text."""
    # The text once, so that its measures share it.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("body")))), F.lit(0))
    thin = stored(texts.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), bits.cast("int").alias("bits")), "failures")
    rows = thin.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    firsts = thin.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    flagged = rows.join(firsts, ["doc_id", "digest"], "left")
    return flagged.select("doc_id", "part", (F.col("bits") + F.when(copy, COPY).otherwise(0)).alias("bits"), "n")


def cell_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: one row per cell that holds documents."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    # Only labelled rows need the join; all rows are counted without it.
    marked = rows.filter("doc_id is not null").join(known.filter("good + toxic > 0"), "doc_id")
    no, n = F.lit(0).cast("long"), F.col("n")
    lost = marked.select("part", "bits", no.alias("n"), (n * F.col("good")).alias("good"), (n * F.col("toxic")).alias("toxic"))
    both = rows.select("part", "bits", "n", no.alias("good"), no.alias("toxic")).unionByName(lost)
    return both.groupBy("part", "bits").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def contract(cells: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """``cells`` (measure, part, 2, ..., 2) against ``selectors`` (case, axis, 2):
    (measure, part, case)."""
    axes = selectors.shape[1]
    letters = "abcdefghijkl"[:axes]
    spec = "xy" + letters + "," + ",".join("z" + c for c in letters) + "->xyz"
    return np.einsum(spec, cells, *(selectors[:, i] for i in range(axes)), optimize=True)


def order_figures(cells: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """Each figure as (part, order, step), orders as ``permutations`` gives them.
    ``cells``: (3: all, good and toxic documents; part; 2; ...; 2), axis i of
    the filters in the order of ``filters``."""
    count = len(filters)
    orders = np.array(list(permutations(range(count))))
    removed, kept = np.empty((len(orders), count, count, 2), np.int64), np.empty((len(orders), count, count, 2), np.int64)
    for o, order in enumerate(orders):
        for step, own in enumerate(order):
            for place, axis in enumerate(order):
                removed[o, step, axis] = PASS if place < step else FAIL if place == step else ALL
                kept[o, step, axis] = PASS if place <= step else ALL
    one = np.arange(count)
    fails, only = np.full((count, count, 2), ALL), np.full((count, count, 2), PASS)
    fails[one, one], only[one, one] = FAIL, FAIL
    shape = (*cells.shape[:2], len(orders), count)
    gone = contract(cells, removed.reshape(-1, count, 2)).reshape(shape)
    stay = contract(cells[:1], kept.reshape(-1, count, 2)).reshape(shape[1:])
    failing, alone = contract(cells[:1], fails)[0], contract(cells[:1], only)[0]
    shares = np.stack([gone[0][:, orders == f].sum(1) for f in range(count)], 1)
    figures = (stay, gone[0], failing[:, orders] - gone[0], alone[:, orders], gone[1], gone[2], shares[:, orders])
    return dict(zip(FIGURES, figures))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the figures: one row per part, order and
    step.  A part is at most 2^filters rows of ``cells``; parts are spread over
    tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["".join(p) for p in permutations(filters)]
        axes = tuple(range(1 + len(filters), 1, -1))  # bit 0 is the last axis of the reshaped counts
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((3, 1, 1 << len(filters)), np.int64)
                for cell in row["cells"]:
                    counts[:, 0, cell["bits"]] = cell["n"], cell["good"], cell["toxic"]
                tensor = counts.reshape(3, 1, *(2,) * len(filters)).transpose(0, 1, *axes)
                figures = order_figures(tensor, filters)
                steps = len(filters)
                columns = [
                    pa.array([row["part"]] * (len(names) * steps), pa.string()),
                    pa.array(np.repeat(names, steps).tolist(), pa.string()),
                    pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))),
                    *(pa.array(figures[f][0].ravel().astype(np.int64)) for f in FIGURES),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *FIGURES])

    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    return grouped.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters over ``docs``, per part and order.  ``labels``: doc_id,
    quality, toxic."""
    rows = stored(failure_bits(docs, id_col, text_col, part_col), "failure-bits")
    return interactions(cell_counts(rows, labels))
