"""Fusion of BM25 and embedding similarity: weighted or by reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25
from ..functions.vector import cosine
from .bm25 import bm25_scores, ranked
from .scratch import stored


@dataclass(frozen=True)
class Fusion:
    """method: `weighted`; anything else is reciprocal rank fusion."""

    method: str = "rrf"
    bm25_weight: float = 0.3
    embed_weight: float = 0.7
    k: int = 60


def similarities(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_id, start_line, similarity) of every chunk with an embedding and every query's vector:
    a stated query set against all chunks."""
    embedded = chunks.where(F.size("embedding") > 0).select("doc_id", "chunk_id", "start_line", "embedding")
    vectors = stored(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"))
    return embedded.join(F.broadcast(vectors), F.lit(True)).select("query_id", "doc_id", "chunk_id", "start_line", cosine(F.col("vector"), F.col("embedding")).alias("similarity"))


def hybrid_scores(chunks: DataFrame, queries: DataFrame, fusion: Fusion | None = None, config: Bm25 | None = None, posted: DataFrame | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_id, score) for queries (query_id, prompt, vector); documents without any embedding, and
    queries without a vector, are ranked by BM25 alone.

    embedded: chunks with embedding (doc_id, chunk_id, start_line, embedding), where chunks hold none; so texts and terms
    needn't be joined to vectors."""
    fusion = fusion or Fusion()
    lexical = bm25_scores(chunks, queries, config, posted)
    near = stored(similarities(chunks if embedded is None else embedded, queries))
    ready = stored(near.select("query_id", "doc_id").distinct())
    alone = lexical.join(ready, ["query_id", "doc_id"], "left_anti")
    lexical = lexical.join(ready, ["query_id", "doc_id"], "left_semi")
    fused = _weighted(lexical, near, fusion) if fusion.method == "weighted" else _reciprocal(lexical, near, chunks, fusion)
    return fused.unionByName(alone.select("query_id", "doc_id", "chunk_id", "score"))


def _weighted(lexical: DataFrame, near: DataFrame, fusion: Fusion) -> DataFrame:
    best = lexical.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"))
    share = lexical.join(best, ["query_id", "doc_id"]).select("query_id", "doc_id", "chunk_id", (F.col("score") / F.col("best")).alias("share"))
    both = share.join(near.drop("start_line"), ["query_id", "doc_id", "chunk_id"], "full")
    own = F.lit(fusion.bm25_weight) * F.coalesce("share", F.lit(0.0))
    score = F.when(F.col("similarity").isNull(), own).otherwise(own + F.lit(fusion.embed_weight) * (F.col("similarity") + 1) / 2)
    return both.select("query_id", "doc_id", "chunk_id", score.alias("score")).where("score > 0")


def _reciprocal(lexical: DataFrame, near: DataFrame, chunks: DataFrame, fusion: Fusion) -> DataFrame:
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.round("similarity", 9).desc(), "start_line")
    parts = ranked(lexical, chunks).select("query_id", "doc_id", "chunk_id", "rank").unionByName(near.select("query_id", "doc_id", "chunk_id", F.row_number().over(order).alias("rank")))
    return parts.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(float(fusion.k)) + F.col("rank"))).alias("score"))
