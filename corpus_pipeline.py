"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All stages but the last return
the columns of documents.

``quality``   the byte-level network drops the documents that it rejects
``toxicity``  the subword classifier drops the documents that it rejects
``dedup``     one document of each group of SimHash near-duplicates stays
``mixing``    blocks are drawn to the sources' target weights: a row per run of
              neighbouring drawn blocks of a document, so an id may occur again
``packing``   the mixed texts as pieces with their sequence and offset

The classifiers learn from all labels of documents that reach their stage (up to
their bounds); nothing is held out here, as no result is measured on labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourbook.llm import mixing, packing, quality_cnn, simhash, toxicity
from hourbook.llm.common import documents, labels, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs, labels(spark, sf_dir)))


def toxicity_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, end_id=1, cut="drop")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("toxicity", toxicity_),
    ("dedup", dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
