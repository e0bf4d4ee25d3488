"""Answers to batches of prompts: within each document, over all documents by rank, and document by document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bm25 import Bm25
from ..functions.text import approx_tokens
from ..operators.bm25 import bm25_scores, ranked
from ..operators.excerpt import BETWEEN, BETWEEN_DOCUMENTS, DEFAULT_TOKENS, NOTHING, NOTHING_ANYWHERE, TOO_SMALL, answers, budgeted, excerpt, most
from ..operators.hybrid import Fusion, hybrid_scores
from ..operators.scratch import stored


def search(chunks: DataFrame, queries: DataFrame, fusion: Fusion | None = None, config: Bm25 | None = None, per_document: bool = True, posted: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Ranked chunks (query_id, doc_id, chunk_id, score, rank, start_line) for queries (query_id, prompt[, vector]), up to rank top."""
    scores = hybrid_scores(chunks, queries, fusion, config, posted) if fusion else bm25_scores(chunks, queries, config, posted)
    return ranked(scores, chunks, per_document, top)


def _top(queries: DataFrame) -> int:
    """The last rank that any of the queries' budgets (query_id, max_tokens) can hold."""
    limit = F.when(F.coalesce("max_tokens", F.lit(0)) <= 0, DEFAULT_TOKENS).otherwise(F.col("max_tokens"))
    return most(queries.agg(F.max(limit)).first()[0])


def answer_each(chunks: DataFrame, queries: DataFrame, fusion: Fusion | None = None, parity: bool = True, posted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, answer) for every query (query_id, prompt, max_tokens) and document that has a hit."""
    found = search(chunks, queries, fusion, posted=posted, top=_top(queries)).join(queries.select("query_id", "max_tokens"), "query_id")
    return answers(budgeted(found.drop("start_line"), chunks, parity))


def answer_ranked(chunks: DataFrame, queries: DataFrame, fusion: Fusion | None = None, posted: DataFrame | None = None) -> DataFrame:
    """(query_id, answer) from the best chunks of all documents together, for every query."""
    found = search(chunks, queries, fusion, per_document=False, posted=posted, top=_top(queries)).join(queries.select("query_id", "max_tokens"), "query_id")
    got = answers(budgeted(found.drop("start_line"), chunks, parity=False, per_document=False), per_document=False)
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING_ANYWHERE)).alias("answer"))


def _that_may_fit(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found (query_id, doc_id, chunk_id, max_tokens, rank) as far as a query's whole budget could hold it. The first excerpt of a
    document may be cut, but takes six tokens; those after it have to fit beside it as they are."""
    sizes = chunks.select("doc_id", "chunk_id", approx_tokens(excerpt(F.col("text"))).alias("tokens"))
    rest = F.sum(F.when(F.col("rank") > 1, F.coalesce("tokens", F.lit(6))).otherwise(0)).over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    near = found.join(sizes, ["doc_id", "chunk_id"]).withColumn("rest", rest).where(F.col("rest") <= F.greatest(F.col("max_tokens") - 6, F.lit(0)))
    return near.select("query_id", "doc_id", "chunk_id", "max_tokens", "rank")


def answer_in_turn(chunks: DataFrame, queries: DataFrame, fusion: Fusion | None = None, posted: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): documents in order of doc_id, each with the budget that those before have left.

    What a document gives depends on what is left, so a query's candidates are folded in order. Every document with a hit
    takes six tokens or more of a budget of b, and so does every excerpt: at most b / 6 + 1 documents of a query, and as
    many chunks of each as b could hold by their sizes, go into the fold; the rest is cut off before texts are joined."""
    limit = F.when(F.coalesce("max_tokens", F.lit(0)) <= 0, DEFAULT_TOKENS).otherwise(F.col("max_tokens"))
    asked = queries.select("query_id", limit.alias("max_tokens"))
    last = F.floor(F.col("max_tokens") / 6) + 1
    found = stored(search(chunks, queries, fusion, posted=posted, top=_top(queries)).join(asked, "query_id").where(F.col("rank") <= last).drop("start_line"))
    order = Window.partitionBy("query_id").orderBy("doc_id")  # a row a document
    first = found.where("rank = 1").select("query_id", "doc_id", "max_tokens", F.row_number().over(order).alias("place")).where(F.col("place") <= last)
    found = found.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"])
    found = stored(_that_may_fit(found, chunks))
    meta = ["doc_id", "chunk_id", "path", "title", "heading_path", "start_line", "end_line", "text"]
    rows = found.join(chunks.select(meta), ["doc_id", "chunk_id"]).select("query_id", "max_tokens", "rank", *meta)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, parts = int(pdf.max_tokens.iloc[0]), []
        for _, own in pdf.sort_values(["doc_id", "rank"]).groupby("doc_id", sort=True):
            if left <= 0:
                break
            text = respond(own.to_dict("records"), left)
            if NOTHING[:20] not in text:
                parts.append(text)
                left -= len(text.encode()) // 4
        return pd.DataFrame({"query_id": [pdf.query_id.iloc[0]], "answer": [BETWEEN_DOCUMENTS.join(parts) or NOTHING_ANYWHERE]})

    kind = dict(queries.dtypes)["query_id"]
    got = rows.groupBy("query_id").applyInPandas(fold, f"query_id {kind}, answer string")
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING_ANYWHERE)).alias("answer"))


def formatted(c: dict, text: str) -> str:
    path = list(c["heading_path"]) if c["heading_path"] is not None else []
    title = " › ".join(path[-2:]) if len(path) > 1 else c["title"]
    return f"### {title}\nSource: {c['path']}#L{c['start_line']}-L{c['end_line']}\n\n{text}\n"


def respond(ranked_chunks: Iterator[dict] | list[dict], budget: int, parity: bool = True) -> str:
    """The excerpts of ranked chunks that the budget holds."""
    size = lambda s: (len(s.encode()) + 3) // 4
    parts, used = [], 0
    for c in ranked_chunks:
        one = formatted(c, c["text"])
        if not parts and (over := size(one) - budget) > 0:
            n = len(c["text"])
            cut = n - 4 * over - (0 if parity else 4)
            cut = min(80, n) if cut < 80 else cut
            one = formatted(c, c["text"][:cut] + "\n…" if cut < n else c["text"])
        if used + size(one) > budget:
            break
        parts.append(one)
        used += size(one)
    return BETWEEN.join(parts) or TOO_SMALL
