"""The corpus pipeline: five stages over `documents`, each one operator's work.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. In every stage null texts count as texts
without words, null and repeated ids are told apart by their texts, rows that
repeat are treated alike, and an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, lines, packing, simhash, toxicity
from ledgerloom.llm.common import read_table, stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; texts without words
    get the score of no evidence."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has (the earlier id,
    null first); n_chars follows, and is null where the text is."""
    return lines.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id (nulls
    last); texts without words are copies of each other."""
    return simhash.one_per_group(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is the
    end token alone."""
    return packing.pack_documents(docs, special_tokens=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark filter", benchmark_filter),
    ("packing", pack),
]

#: Trained scores, hashes and token ids aren't SQL; tests hold every stage, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
