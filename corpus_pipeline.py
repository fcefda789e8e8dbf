"""The corpus pipeline: toxicity, near duplicates, secrets, mix, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewatch.llm import bpe, mixing, secrets_crf, simhash, toxicity
from pulsewatch.llm.common import ship, staged, table
from pulsewatch.llm.queries import vocabulary
from pulsewatch.session import prepare

#: No SQL for the trained and hashed stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half.  Null and empty texts
    are scored as texts without words, repeated rows each for itself; columns go
    through as they are, an empty table stays empty."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), score_col="__score", predicted_col="__predicted")
    return scored.where("__predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id
    (ids missing: by the text's hash).  Null and empty texts are copies of each
    other, and of rows alike in id and text one stays; an empty table stays empty."""
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    found = simhash.near_duplicates(hashed, shingle_words=4, distance=4, keep=("__hash",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__hash"))
    kept = found.groupBy("component").agg(first.alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.__hash").alias("__text_hash"))
    kept = staged(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text_hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__hash"]).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted again where
    that happened.  Null and empty texts hold no secret and stay as they are,
    repeated rows stay repeated, an empty table stays empty."""
    found = secrets_crf.find_secrets(docs, out_col="__secrets")
    masked = found.withColumn("__text", secrets_crf.mask("text", "__secrets"))
    if "n_chars" in docs.columns:
        changed = F.size("__secrets") > 0
        masked = masked.withColumn("n_chars", F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars")))
    return masked.withColumn("text", F.col("__text")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source of
    its own.  Texts without words weigh nothing, rows alike in id, source and size
    share their copies in the order of their texts, an empty table stays empty."""
    return mixing.apply_copies(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none, repeated rows
    stay repeated, an empty table stays empty."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), want=("n_tokens", "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    prepare(spark)
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
