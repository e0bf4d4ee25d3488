"""Corpora over the driver's tables: S for search, M for chunking, P for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_terms

#: Documents of one Markdown file of corpus M; a file never grows beyond it.
PER_FILE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: a document is a source, its chunks are the rows, with doc_id as line and every fourth holding code."""
    d = table(spark, sf_dir, "documents")
    line = F.col("doc_id").cast("int")
    return d.select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.col("source"), F.lit(".md")).alias("path"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"),
        F.array(F.col("source"), F.col("lang")).alias("heading_path"), line.alias("start_line"), (line + 1).alias("end_line"), F.col("text"), (F.col("doc_id") % 4 == 0).alias("has_code"), normalize_terms(F.col("text")).alias("terms"),
    )


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_id, start_line, embedding) of corpus S: the embeddings whose vec_id is the row's doc_id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return search_corpus(spark, sf_dir).select("doc_id", "chunk_id", "start_line").join(vectors, "chunk_id")


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content): rows of one source, 50 ids to a file, under headings, with fences, tables, blank runs,
    tags and entities on some."""
    d = table(spark, sf_dir, "documents")
    i, group = F.col("doc_id"), F.floor(F.col("doc_id") / PER_FILE)
    some = lambda n, text: F.when(i % n == 0, F.lit(text)).otherwise(F.lit(""))
    part = F.concat(
        F.lit("## Doc "), i, F.lit(" ("), F.col("lang"), F.lit(")\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"),
        some(5, "```sql\nSELECT 1;\n# not a heading\n| not | a row |\n```\n"), some(7, "| Name | Kind |\n| --- | :--: |\n| alpha | beta |\n"), some(11, "\n\n\n\n"),
        some(13, "<b>bold</b> &amp; <i>it</i>&nbsp;&copy;\n"), some(17, "### Part\n#### Deep\n\ntail\n"),
    )
    # at most PER_FILE rows a file
    files = d.groupBy("source", group.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", part.alias("part")))), lambda x: x["part"]), "").alias("body"))
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("-"), F.col("part"), F.lit(".md"))
    return files.select(F.substring(F.sha2(path, 256), 1, 16).alias("doc_id"), path.alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "body").alias("content"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, prompt, max_tokens): the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("prompt"), F.lit(2000).alias("max_tokens"))
