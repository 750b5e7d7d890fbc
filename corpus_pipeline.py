"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import packing, passages, quality, secrets, simhash
from lexspan.llm.common import Tables, bounded, swept, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines; rejected documents go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of smallest id."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document with nothing left goes."""
    return passages.drop_passages(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows."""
    return packing.pack(docs)


STAGES = [(name, bounded(stage)) for name, stage in (("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup), ("substring dedup", substring_dedup), ("secret scan", secret_scan), ("packing", pack_windows))]
#: SQL has no tokenizer for the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is in the shared folder, the last of it for the rows returned. A stage's own tables and its
    predecessor's documents go once its documents are written."""
    docs, made = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with swept():
            docs = made.put(str(n), stage(spark, docs, sf_dir))
        if n:
            made.drop(str(n - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
