"""From raw documents to packed training sequences.

Each stage is written as Parquet and read again by the next one; all but the last return the columns of ``documents``.  Null and
repeated rows, ties and empty tables are treated as the operators state.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, near_duplicates, packing, pii, quality, queries
from attestra.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_duplicates.one_of_each(docs.select(*COLUMNS), rare=None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [("quality classifier", keep_good), ("MinHash near-dedup", keep_one_of_each), ("benchmark decontamination", drop_contaminated), ("PII", redact),
          ("best-fit packing", pack)]
# the classifiers and the tokenizer have no SQL; tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
