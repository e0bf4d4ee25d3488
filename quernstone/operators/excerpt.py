"""Excerpts of ranked chunks within a token budget, and answers put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from .scratch import stored

#: Separators and texts that callers rely on.
BETWEEN = "\n--------------------------------\n\n"
BETWEEN_DOCUMENTS = "\n\n---\n\n"
DEFAULT_TOKENS = 500
NOTHING = "No relevant excerpts found in the indexed document."
NOTHING_ANYWHERE = "No relevant excerpts found in any loaded document."
TOO_SMALL = "Token limit too small to return any excerpt."


def excerpt(text: Column) -> Column:
    """Title line (the last two headings, or the title), source line, text."""
    deep = F.size("heading_path") > 1
    title = F.when(deep, F.concat_ws(" › ", F.slice("heading_path", -2, 2))).otherwise(F.col("title"))
    return F.concat(F.lit("### "), title, F.lit("\nSource: "), "path", F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit("\n\n"), text, F.lit("\n"))


def most(tokens: int | None) -> int:
    """As many excerpts as a budget holds at most, and one: an excerpt takes six tokens at least."""
    return (tokens if tokens and tokens > 0 else DEFAULT_TOKENS) // 6 + 1


def budgeted(found: DataFrame, chunks: DataFrame, parity: bool = True, per_document: bool = True) -> DataFrame:
    """found (query_id, doc_id, chunk_id, score, rank, max_tokens) with excerpt, tokens, used and fits.

    fits: the excerpts up to this one stay within max_tokens. Where the first excerpt is too large, its text is cut to
    the code points that are over, four a token, but 80 at least; in parity mode the mark that follows isn't made room
    for."""
    keys = ["query_id", "doc_id"] if per_document else ["query_id"]
    budget = F.when(F.coalesce("max_tokens", F.lit(0)) <= 0, DEFAULT_TOKENS).otherwise(F.col("max_tokens"))
    # as in most(); stored, as Spark would deal out all texts for a join with rows of unknown number
    near = stored(found.withColumn("max_tokens", budget).where(F.col("rank") <= F.floor(F.col("max_tokens") / 6) + 1))
    meta = [c for c in ("path", "title", "heading_path", "start_line", "end_line", "text") if c not in found.columns]
    near = near.join(chunks.select("doc_id", "chunk_id", *meta), ["doc_id", "chunk_id"])
    whole = excerpt(F.col("text"))
    over = approx_tokens(whole) - F.col("max_tokens")
    size = F.length("text")
    cut = size - over * 4 - (0 if parity else 4)
    cut = F.when(cut < 80, F.least(F.lit(80), size)).otherwise(cut)
    trimmed = F.when(cut < size, F.concat(F.substring(F.col("text"), F.lit(1), cut), F.lit("\n…"))).otherwise(F.col("text"))
    near = near.withColumn("excerpt", F.when((F.col("rank") == 1) & (over > 0), excerpt(trimmed)).otherwise(whole)).withColumn("tokens", approx_tokens(F.col("excerpt")))
    running = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("used", F.sum("tokens").over(running)).withColumn("fits", F.col("used") <= F.col("max_tokens"))


def answers(fitted: DataFrame, per_document: bool = True) -> DataFrame:
    """(query_id[, doc_id], answer) of budgeted excerpts."""
    keys = ["query_id", "doc_id"] if per_document else ["query_id"]
    # a budget bounds the excerpts of an answer
    kept = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("rank", "excerpt"))))
    text = F.array_join(F.transform(kept, lambda x: x["excerpt"]), BETWEEN)
    return fitted.groupBy(*keys).agg(F.when(F.count_if("fits") > 0, text).otherwise(F.lit(TOO_SMALL)).alias("answer"))
