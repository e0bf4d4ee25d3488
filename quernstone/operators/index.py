"""Index tables of chunks: postings, term statistics and document statistics. Statistics are those of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BETWEEN = "\x1f"


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, term, tf)."""
    return chunks.select("doc_id", "chunk_id", F.explode("terms").alias("term")).groupBy("doc_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(doc_id, term, df): the chunks of the document that hold the term, a row of postings each."""
    return posted.groupBy("doc_id", "term").agg(F.count("*").alias("df"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, num_chunks, avg_len); chunks without terms count."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks"), F.avg(F.size("terms")).alias("avg_len"))


def full_postings(chunks: DataFrame, by: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, chunk_id, term, tf, df, length, num_chunks, avg_len, has_code): all that ranking needs of a term in a chunk.

    The chunks' terms are dealt out once, to parts tasks by what by makes of doc_id (columns that the result has, too): all
    statistics are those of a document, which is within one task then."""
    by = by or {}
    keys = [*by, "doc_id"]
    # as one text, terms take less than half of what an array of them takes
    rows = chunks.select("doc_id", "chunk_id", "has_code", F.size("terms").alias("length"), F.array_join("terms", _BETWEEN).alias("words")).withColumns(by)
    rows = rows.repartition(*([parts] if parts else []), *(list(by) or keys))
    of_doc, of_term = Window.partitionBy(*keys), Window.partitionBy(*keys, "term")
    rows = rows.withColumns({"num_chunks": F.count("*").over(of_doc), "avg_len": F.avg("length").over(of_doc)})
    own = F.struct("length", "num_chunks", "avg_len", "has_code").alias("own")
    posted = rows.where("length > 0").select(*keys, "chunk_id", own, F.explode(F.split("words", _BETWEEN)).alias("term")).groupBy(*keys, "chunk_id", "term").agg(F.count("*").alias("tf"), F.first("own").alias("own"))
    return posted.withColumn("df", F.count("*").over(of_term)).select(*keys, "chunk_id", "term", "tf", "df", "own.*")


def doc_freq_map(stats: DataFrame) -> DataFrame:
    """(doc_id, doc_freq): term statistics as a map, for export of single documents' indexes."""
    return stats.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "df")))).alias("doc_freq"))
