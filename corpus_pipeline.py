"""Corpus pipeline: quality classifier, near-dedup, personal data, mixing, BPE ids and back.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next.  All but the last
return the columns of ``documents``; decisions of a stage take effect: rejected
documents and near copies go, personal data are masked, the mix leaves out or
repeats documents, and the last stage gives token ids and
whether they decode to the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, minhash, mixing, pii, quality_bayes
from foldwise.session import ensure_checkpoint_dir, read_table, remove_folder

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    scored = quality_bayes.classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the least id, at op1's limit of 85 %.  Rows of equal id and text
    are copies whatever the text; rows without id and without words stay."""
    return minhash.least_of_groups(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kind."""
    done = pii.detect(docs, masked_col="masked")
    chars = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return done.withColumns({"text": F.col("masked"), "n_chars": F.coalesce(chars, F.col("n_chars"))}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256, same_text) of every document of the mix: ids as little-endian
    32-bit binary, the digest of the text they decode to, and whether that is the document's."""
    done = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded="decoded")
    return done.select("doc_id", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", bpe_ids),
]

ORACLE_SQL = None   # a fitted classifier and a tokenizer are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again, and removed
    once the next is there.  The last one stays, as the result reads it."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    return docs
