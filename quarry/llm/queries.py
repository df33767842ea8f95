"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import ann, bpe, decontam, gru_lm, license as licences, oracle, rules, secrets, simhash, suffix_dedup, toxicity
from quarry.llm.common import crc_mod, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start elsewhere, too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by rules learnt outside the held fold."""
    docs = table(spark, sf_dir, "documents")
    found = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.score_documents(docs, found).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document, by the network and by the unigram base."""
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and of the decoded bytes of every document."""
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items concerned."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.find_contamination(docs, items))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op8_toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a machine learnt outside the held fold."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(), "component_id")


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, with the ownership of their values."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_cross_polytope, op3_quality_rules, op4_gru_lm, op5_bpe_codec, op6_decontaminate, op7_license_scan, op8_toxicity_svm, op9_simhash, op10_secret_ownership)}
ORACLES: dict[str, str] = {"op1_suffix_dedup": oracle.REPEATS, "op6_decontaminate": oracle.CONTAMINATION, "op10_secret_ownership": oracle.secrets_sql()}
