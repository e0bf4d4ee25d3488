"""Embeddings of chunks, from a table or from a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_text

EmbedBatch = Callable[[list[str]], list[list[float] | None]]


def embed_chunks(chunks: DataFrame, embed: EmbedBatch, parallel: int = 2) -> DataFrame:
    """chunks with embedding from a call for each batch; where the call fails or the count doesn't fit, null.

    parallel bounds how many calls run at once."""
    rows = chunks.drop("embedding").withColumn("__text", embedding_text(F.col("heading_path"), F.col("text")))
    keys = rows.select("doc_id", "chunk_id", "__text").repartition(max(1, parallel))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                vectors = embed(pdf["__text"].tolist()) if len(pdf) else []
            except Exception:  # noqa: BLE001  search goes on with BM25
                vectors = []
            if len(vectors) != len(pdf):
                vectors = [None] * len(pdf)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "chunk_id": pdf.chunk_id, "embedding": vectors})

    vectors = keys.mapInPandas(run, "doc_id string, chunk_id string, embedding array<float>")
    return rows.drop("__text").join(with_null_for_empty(vectors), ["doc_id", "chunk_id"], "left")


def with_null_for_empty(vectors: DataFrame) -> DataFrame:
    """An empty embedding means none."""
    return vectors.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))


def attach(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """chunks with the embeddings of a table (key, embedding)."""
    return chunks.drop("embedding").join(with_null_for_empty(vectors.select(key, "embedding")), key, "left")
