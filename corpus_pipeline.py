"""The corpus pipeline: five stages, each an operator of quarry.llm, over whole tables.

Quality classifier, SimHash near-duplicates, benchmark decontamination, secret scan
and byte-level BPE. Each stage takes (spark, docs, sf_dir); all but the last return
the columns of documents. Whatever a stage returns is written as Parquet and read
again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import bpe, decontam, rules, secrets, simhash
from quarry.llm.common import discard, table, text_key, written
from quarry.llm.queries import VOCABULARY


#: Bytes of text keys up to which these are sent to every task.
BROADCAST_BYTES = 8 << 20


def _own(docs: DataFrame) -> DataFrame:
    """The documents' columns as one, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    found = rules.train(docs, table(spark, sf_dir, "labels"))
    mine = _own(docs).select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    return _given(rules.score_documents(mine, found, keep=("_row",)).where(F.col("score") >= 0.5), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8), the row of the smallest id stays, once.

    Rows are told apart by id and text: several texts of one id, or of none, are judged
    separately. Null ids come last, and of one id the smallest text key stays.
    """
    kept = simhash.representatives(docs).select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    mine = _own(docs).withColumns({"_id": F.col("_row.doc_id"), "_key": text_key("_row.text")})
    stay = mine.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    return _given(stay.dropDuplicates(["_id", "_key"]), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    index = decontam.build(docs)
    found = decontam.search(index, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    # texts decide, so rows are told by their texts; 16 bytes each
    hits = written(found.select(F.col("key").alias("_of_key")).distinct(), f"hits-{uuid.uuid4().hex}")
    discard(index)
    n = hits.count()
    held = F.broadcast(hits) if n * 64 <= BROADCAST_BYTES else hits
    mine = _own(docs)
    return _given(mine.join(held, text_key("_row.text") == F.col("_of_key"), "left_anti"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base secrets, and added candidates that look live, give way to a mark; n_chars follows the text."""
    # spans follow from the text and the corpus, so they are looked up by text: ids may repeat or be null
    mine = _own(docs).withColumns({"_key": text_key("_row.text")})
    asked = mine.select(F.col("_key"), F.col("_row.doc_id").alias("repository"), _column(docs, "source").alias("owner"), F.col("_row.text").alias("text"))
    found = secrets.scan(asked, "owner", "repository", "_key").select(F.col("_key").alias("_of_key"), F.concat("base", "live").alias("_spans")).where(F.size("_spans") > 0)
    joined = mine.join(found.dropDuplicates(["_of_key"]), F.col("_key") == F.col("_of_key"), "left")
    text, clean = F.col("_row.text"), F.col("_spans").isNull()
    masked = F.when(clean, text).otherwise(secrets.redacted(text, F.col("_spans")))
    joined = joined.select(F.col("_row").withField("text", masked).alias("_row"), clean.alias("_clean"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("_row", F.col("_row").withField("n_chars", F.when(F.col("_clean"), F.col("_row.n_chars")).otherwise(F.length("_row.text").cast("bigint"))))
    return _given(joined, docs)


def _column(docs: DataFrame, name: str):
    return F.col(f"_row.{name}") if name in docs.columns else F.lit(None).cast("string")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

#: SQL can't express the classifier, the fingerprints and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}-{uuid.uuid4().hex}")
            if before is not None:  # what the stage read is written anew
                discard(before)
            before = docs
    return docs
