"""Token ids as flat binary files with document offsets.

Documents are range-partitioned by id and sorted; each partition writes three
files: ``.ids`` (unsigned integers, little-endian, 16 bits wide if the
vocabulary allows it, else 32), ``.off`` (signed 64-bit offsets into the ids, one
more than documents) and ``.doc`` (signed 64-bit document ids).  A manifest
lists the files of the attempts that ended well, with prefix sums over the
partitions as bases, so the files read as one array: token ``offset + base`` is
the same place for every reader.  Readers memory-map the files where the folder
is a local or mounted one, and read them through the file system's own client
elsewhere.

Names hold a random part, so a repeated or speculative attempt never writes to
a file that another one has opened; what the manifest doesn't list is unused.

Defined results: a null or empty text holds the end id alone; null ids come
first; equal ids are ordered by a hash of the text; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourbook.llm.common import shared_path, stored
from hourbook.llm.encoding import slices, worker_encoder

SHARD = "part int, name string, docs long, null_ids long, tokens long"


@dataclass(frozen=True)
class TokenFiles:
    """A written set: the folder, the width of an id in bytes and the shards
    in order, each with its bases (documents and tokens before it)."""

    folder: str
    width: int
    shards: list[tuple[str, int, int, int, int]]  # name, documents, null ids, document base, token base
    tokens: int


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, cut: str | None, vocabulary: int, folder: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> TokenFiles:
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store, path = worker_encoder(tokenizer_path, cut, end_id), *fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name, offset, count, nulls = f"{part:06d}-{uuid.uuid4().hex}", 0, 0, 0
        files = [store.open_output_stream(f"{path}/{name}.{kind}") for kind in ("ids", "off", "doc")]
        ids_file, off_file, doc_file = files
        off_file.write(np.array([0], "<i8").tobytes())
        for batch in batches:
            for piece in slices(batch, 1):
                coded = encoder.encode(piece.column(1).to_pylist())
                ids = np.frombuffer(b"".join(coded), "<u4")
                ids_file.write(ids.astype(f"<u{width}").tobytes())
                ends = offset + np.cumsum([len(x) // 4 for x in coded])
                off_file.write(ends.astype("<i8").tobytes())
                doc_file.write(piece.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                offset, count, nulls = int(ends[-1]), count + piece.num_rows, nulls + piece.column(0).null_count
        for f in files:
            f.close()
        if count:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": name, "docs": count, "null_ids": nulls, "tokens": offset}],
                pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("null_ids", pa.int64()), ("tokens", pa.int64())]),
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = stored(sorted_.mapInArrow(run, SHARD), "token-manifest")
    shards, docs_before, tokens_before = [], 0, 0
    for r in manifest.orderBy("part").collect():  # one row per partition
        shards.append((r["name"], r["docs"], r["null_ids"], docs_before, tokens_before))
        docs_before, tokens_before = docs_before + r["docs"], tokens_before + r["tokens"]
    return TokenFiles(folder, width, shards, tokens_before)


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (place of the first id), n_tokens,
    ids_crc32 (of the ids as 32-bit integers), and with ``with_ids`` the ids."""
    folder, width = files.folder, files.width
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int64()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                base = f"{path}/{shard['name']}"
                ids, off, doc = (_mapped(store, f"{base}.{k}", t) for k, t in (("ids", f"<u{width}"), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, shard["docs"], 2000):
                    ends = off[at : at + 2001]
                    block, cuts = ids[ends[0] : ends[-1]].astype("<u4"), (ends - ends[0]).tolist()
                    own = [block[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                    columns = [
                        pa.array(doc[at : at + 2000], mask=np.arange(at, at + len(own)) < shard["null_ids"]),
                        pa.array(ends[:-1] + shard["token_base"]),
                        pa.array(np.diff(ends)),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array(own, pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    rows = [(n, d, z, t) for n, d, z, _, t in files.shards]
    shards = spark.createDataFrame(rows, "name string, docs long, null_ids long, token_base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
