"""The operators as registered queries, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import audio, decontamination, licenses, lines, minhash, negatives, packing, prefixes, secrets, sharding, simhash, toxicity, urls
from ledgerloom.llm.common import read_table
from ledgerloom.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, shards=40)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_column(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), special_tokens=True)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(read_table(spark, sf_dir, "documents"))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_lines": op2_lines,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_audio": op6_audio,
    "op7_decontamination": op7_decontamination,
    "op8_urls": op8_urls,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_minhash": op11_minhash,
    "op12_prefixes": op12_prefixes,
    "op13_negatives": op13_negatives,
}
