"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has bit i set if more than half of its shingle
hashes (XXH64) have it set.  Documents whose fingerprints differ in at most
``MAX_BITS`` bits are linked; a group is a connected component.

Links are found with a covering code.  Each fingerprint is cut into two
halves; of two fingerprints that differ in at most 3 bits, one half differs
in at most t = 1.  Anchors of a half are the words of the perfect Hamming
code [31, 26] on 31 of its bits: every half lies within R = 1 of exactly one
anchor, its home.  A fingerprint is replicated to all anchors within R + t = 2
(at most 16 of 2^26), so linked fingerprints meet at a home anchor.  What an
anchor gathers is compared in full, on all 64 bits.

What keeps this bounded: only distinct fingerprints are replicated, so any
number of exact copies counts once; an anchor yields a spanning forest of its
links (fewer edges than members), never all pairs; an anchor with more than
``ANCHOR_LIMIT`` members is set aside and redone as pairs of member blocks in
tasks of their own, so every pair is still compared.  Components come from
alternating large-star and small-star steps with stored results.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a null doc_id takes part, and the component id is the smallest
doc_id that is not null (null if there is none); equal rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import fresh_name, join_spread, row_hash, stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
ANCHOR_LIMIT = 8000
SMALL_BUCKET = 8
SHINGLES_AT_ONCE = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of UTF-8 text: A-Z lower-cased, words between
    ASCII white space, shingles joined by one space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[size:]
    n, ones, digest = len(ends), np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, n, SHINGLES_AT_ONCE):
        part = zip(starts[i : min(i + SHINGLES_AT_ONCE, n)], ends[i : i + SHINGLES_AT_ONCE])
        raw = b"".join([digest(joined[a : b - 1], seed) for a, b in part])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED, row_col: str | None = None
) -> DataFrame:
    """doc_id, text_hash (tells rows of one id apart), fp (signed long), and
    own_row, the column ``row_col`` of the documents, if it is given."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in texts.cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.array(values.view(np.int64))

    own = [F.col(row_col).alias("own_row")] if row_col else []
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fp(F.col(text_col).cast("binary")).alias("fp"), *own)


def _anchor_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 16-bit value at bit 0, flips): flips[s] are the masks
    that turn a word of syndrome s into the code words within distance 2."""
    bits = np.arange(1, 32)
    flips = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        masks = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in bits if i < (i ^ s)]
        flips[s] = masks
    low = np.zeros(1 << 16, np.uint8)
    for i in range(16):
        low ^= np.where((np.arange(1 << 16) >> i) & 1, i + 1, 0).astype(np.uint8)
    high = np.zeros(1 << 15, np.uint8)
    for i in range(15):
        high ^= np.where((np.arange(1 << 15) >> i) & 1, i + 17, 0).astype(np.uint8)
    return np.concatenate([low, high]), flips


def anchors(fps: np.ndarray) -> np.ndarray:
    """n x 32 anchor keys of n unsigned fingerprints; a code word has only one
    anchor within reach, which then fills its row of 16."""
    syndromes, flips = _anchor_tables()
    keys = []
    for half in (0, 1):
        word = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = syndromes[word & 0xFFFF] ^ syndromes[(1 << 16) + (word >> 16)]
        keys.append((word[:, None] ^ flips[s]).astype(np.int64) | (half << 31))
    return np.concatenate(keys, axis=1)


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp) for each distinct fingerprint and anchor in reach."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            keys = anchors(fp)
            once = np.ones(keys.shape, bool)
            once[:, 1:] = keys[:, 1:] != keys[:, :1]
            once[:, 17:] &= keys[:, 17:] != keys[:, 16:17]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[once]), pa.array(np.broadcast_to(fp.view(np.int64)[:, None], keys.shape)[once])], ["anchor", "fp"]
            )

    return fps.select("fp").mapInArrow(expand, "anchor long, fp long")


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges (index, index of its tree's root) of the links among ``fp``."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= bits
            found = left[near]
            if len(found):
                left = left[~near]
                queue.extend(found)
                edges.extend((int(x), int(root)) for x in found)
    return edges


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the groups of a sorted key: all pairs of groups of up to
    SMALL_BUCKET members, a spanning forest of larger ones."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    us, vs = [], []
    for d in range(1, min(SMALL_BUCKET, len(key))):
        at = np.flatnonzero(small[d:] & (key[d:] == key[:-d]))
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        us.append(fp[at])
        vs.append(fp[at + d])
    for i in np.flatnonzero(sizes > SMALL_BUCKET):
        part = fp[starts[i] : starts[i] + sizes[i]]
        if edges := _forest(part, bits):
            e = np.array(edges)
            us.append(part[e[:, 0]])
            vs.append(part[e[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _compare(members: DataFrame, keys: list[str], bits: int, limit: int | None) -> DataFrame:
    """(u, v, anchor) over members (keys..., fp): links with a null anchor; and
    with a limit, the members of larger groups as (fp, null, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(u, v, anchor):
            n = len(u)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(u.view(np.int64)),
                    pa.array(v.view(np.int64)) if v is not None else pa.nulls(n, pa.int64()),
                    pa.array(anchor) if anchor is not None else pa.nulls(n, pa.int64()),
                ],
                ["u", "v", "anchor"],
            )

        def done(cols, fp):
            if len(fp):
                change = np.zeros(len(fp), bool)
                change[0] = True
                for c in cols:
                    change[1:] |= c[1:] != c[:-1]
                u, v = _links(np.cumsum(change), fp, bits)
                if len(u):
                    yield rows(u, v, None)

        held = [np.zeros(0, np.int64) for _ in range(len(keys) + 1)]
        large = None  # the key whose members are being set aside
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            if large is not None:
                n = int(np.searchsorted(held[0], large, "right"))
                if n:
                    yield rows(held[-1][:n].view(np.uint64), None, held[0][:n])
                held = [h[n:] for h in held]
                if not len(held[0]):
                    continue
                large = None
            # The last group may go on in the next batch.
            last = np.ones(len(held[0]), bool)
            for h in held[:-1]:
                last &= h == h[-1]
            cut = int(np.argmax(last))
            if limit is not None:
                # Larger groups inside the batch are set aside as well.
                key = held[0][:cut]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if cut else np.zeros(0, int)
                sizes = np.diff(np.r_[starts, cut])
                aside = np.repeat(sizes > limit, sizes) if cut else np.zeros(0, bool)
                if aside.any():
                    yield rows(held[-1][:cut][aside].view(np.uint64), None, key[aside])
                yield from done([key[~aside]], held[-1][:cut][~aside].view(np.uint64))
            else:
                yield from done([h[:cut] for h in held[:-1]], held[-1][:cut].view(np.uint64))
            held = [h[cut:] for h in held]
            if limit is not None and len(held[0]) > limit:
                large = held[0][0]
                yield rows(held[-1].view(np.uint64), None, held[0])
                held = [h[:0] for h in held]
        yield from done(held[:-1], held[-1].view(np.uint64))

    sorted_ = members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp")
    return sorted_.mapInArrow(run, "u long, v long, anchor long")


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(u, v) edges over distinct fingerprints whose components are those of
    all links at ``bits`` differing bits or fewer (at most 3)."""
    if bits > MAX_BITS:
        raise ValueError("the halves' anchors cover at most 3 differing bits")
    found = stored(_compare(replicas(fps), ["anchor"], bits, limit), "simhash-links")
    aside = found.filter("anchor is not null").select("anchor", F.col("u").alias("fp"))
    # Blocks of a large anchor meet in pairs; (lo, hi) names the pair.
    blocks = aside.groupBy("anchor").agg(F.ceil(F.count("*") / limit).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    paired = (
        aside.join(blocks, "anchor")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("anchor", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    again = _compare(paired, ["anchor", "lo", "hi"], bits, None)
    return found.filter("anchor is null").select("u", "v").union(again.select("u", "v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component.  Only nodes
    with an edge to another node appear."""
    both = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(both(edges).filter("u <> v").distinct(), "components")
    mark = None
    while True:
        at = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if at == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        mark = at
        # Large star: larger neighbours of u point to u's smallest neighbour.
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The root of a large component has most edges: its rows are joined apart.
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_spread(around, stored(least, "components-least"), ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u, and u, point to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, root (the component's
    smallest fingerprint), component_id (its smallest doc_id), and own_row, the
    column ``row_col`` of the documents, if it is given."""
    table = stored(fingerprints(docs, id_col, text_col, shingle, seed, row_col), "fingerprints")
    distinct = stored(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(fingerprint_links(distinct, bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only members of larger components need their group's smallest id.
    ids = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_least"))
    named = rooted.join(ids, "root", "left").select("fp", "root", F.coalesce("component_least", "least").alias("component_id"), "n")
    own = ["own_row"] if row_col else []
    # Exact copies share a fingerprint, so one may hold most documents.
    return join_spread(table, stored(named, "named"), ["fp"], "n").select("doc_id", "text_hash", "fp", "root", "component_id", *own)


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest
    (doc_id, text hash), null ids last; of equal rows the smallest."""
    own, tie = fresh_name(docs, "own_row"), fresh_name(docs, "own_tie")
    # Every row gets a number, so only the rows that stay move, and equal ones never meet.
    marked = stored(docs.withColumn(own, F.monotonically_increasing_id()).withColumn(tie, row_hash(docs)), "dedup-rows")
    table = near_duplicates(marked, id_col, text_col, row_col=own, **options)
    ties = marked.select(F.col(own).alias("own_row"), F.col(tie).alias("tie"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "tie", "own_row")
    kept = table.join(ties, "own_row").groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.own_row").alias(own))
    return marked.join(kept, own, "left_semi").drop(own, tie)
