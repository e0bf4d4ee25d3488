"""The corpus pipeline: what stays of `documents` after each stage, and at last its token ids' digests.

Null texts and ids pass through the filtering stages (a null text is an empty one); rows that repeat an id and its text
are one document; an empty table comes out empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import bpe_digests
from quernstone.llm.common import stored, text_key, whole_text
from quernstone.llm.decontaminate import decontaminated
from quernstone.llm.minhash import near_duplicates
from quernstone.llm.substring import remove_repeats
from quernstone.llm.toxicity import below, fit_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Without the documents whose score reaches the threshold; fitted on the labelled ones among docs."""
    return below(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates."""
    found = near_duplicates(docs, with_key=True).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = found.select(F.col("doc_id").alias("id"), "key")  # another text of the same id may stay
    rows = docs.select(F.struct("*").alias("row")).withColumns({"id": F.col("row.doc_id"), "key": text_key(whole_text("row.text"))})
    return rows.join(gone, ["id", "key"], "left_anti").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of passages that another document, or an earlier place, has first."""
    return remove_repeats(docs, count=None).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: String kernels, BagMinHash, edit distances and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)  # read by the next stage, more than once
    return STAGES[-1][1](spark, docs, sf_dir)
