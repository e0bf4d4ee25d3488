"""BM25 ranking of chunks within their documents, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25, idf, saturation
from ..functions.text import normalize_terms
from .index import term_stats
from .scratch import stored


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf) of queries (query_id, prompt)."""
    return queries.select("query_id", F.explode(normalize_terms(F.col("prompt"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def _posted(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Full postings of the asked terms, with start_line, from one reading of the chunks.

    A row with an empty term (no chunk has one of its own) stands for each chunk, so that the documents' statistics come from
    the same reading; only rows of asked terms and these leave the task that reads the chunk."""
    own = F.struct("has_code", "start_line", F.size("terms").alias("length")).alias("own")
    rows = chunks.select("doc_id", "chunk_id", own, F.explode(F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    wanted = asked.unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term")))
    counted = rows.join(wanted, "term", "left_semi").groupBy("doc_id", "chunk_id", "term").agg(F.count("*").alias("tf"), F.first("own").alias("own"))
    counted = stored(counted.select("doc_id", "chunk_id", "term", "tf", "own.*"))
    hits = counted.where("term <> ''")
    of_docs = counted.where("term = ''").groupBy("doc_id").agg(F.count("*").alias("num_chunks"), F.avg("length").alias("avg_len"))
    return hits.join(stored(term_stats(hits).join(of_docs, "doc_id")), ["doc_id", "term"])


def bm25_scores(chunks: DataFrame, queries: DataFrame, config: Bm25 | None = None, posted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_id, score[, start_line]) of chunks with a score over 0.

    posted: full postings (see index.full_postings), where they are stored; else they are made of the chunks, cut to the
    queries' terms before anything is joined to them, with start_line. Spark broadcasts the terms where their measured size
    allows; postings are dealt by chunk, so that sums over a chunk's terms need no rows for each query to be dealt again."""
    config = config or Bm25()
    terms = stored(query_terms(queries))
    asked = terms.select("term").distinct()
    weighed = _posted(chunks, asked) if posted is None else posted.join(asked, "term", "left_semi")
    line = ["start_line"] if posted is None else []
    weight = idf(F.col("num_chunks"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("avg_len"), config)
    weighed = weighed.select("doc_id", "chunk_id", "term", "has_code", *line, weight.alias("weight")).repartition("doc_id", "chunk_id")
    score = weighed.join(terms, "term").groupBy("query_id", "doc_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("qf")).alias("score"), F.first("has_code").alias("has_code"), *(F.first(c).alias(c) for c in line))
    boosted = F.when(F.col("has_code") & (F.col("score") > 0), F.col("score") * F.lit(config.code_boost)).otherwise(F.col("score"))
    return score.select("query_id", "doc_id", "chunk_id", boosted.alias("score"), *line).where("score > 0")


def ranked(scores: DataFrame, chunks: DataFrame, per_document: bool = True, top: int | None = None) -> DataFrame:
    """scores with start_line and rank: by score (at nine digits, so that the order of sums doesn't matter), then place.

    top: only ranks up to it, which Spark cuts before it deals the rows out."""
    keys = ["query_id", "doc_id"] if per_document else ["query_id"]
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), *([] if per_document else ["doc_id"]), "start_line")
    if "start_line" not in scores.columns:
        scores = scores.join(chunks.select("doc_id", "chunk_id", "start_line"), ["doc_id", "chunk_id"])
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)
