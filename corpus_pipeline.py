"""A corpus pipeline: quality, shared lines, near duplicates, personal data, packing.

Every stage but the last returns the columns of its input, whatever they are, and each one's result is what the next
one reads. Null texts pass as they are (the classifier may reject them), and are packed as the end token alone; of
repeated rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import lines, minhash, packing, pii, quality
from faultline.llm.common import standing_on, table, unlink, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted to the labels, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents share."""
    return lines.dedup_lines(docs, min_docs=10, least=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return minhash.dedup(docs, contain=0.6, ratio=0.4)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=1024, end=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal),
    ("packing", pack_sequences),
]

#: The classifier can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table that the next one reads, and deleted when that is
    written. The last one's rows read the one before: ``unlink`` of them deletes it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        after = written(made, name, clean=True)
        unlink(docs, made)
        docs = after
    return standing_on(STAGES[-1][1](spark, docs, sf_dir), docs)
