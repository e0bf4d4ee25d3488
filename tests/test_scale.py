"""What grows with the tables: how often inputs are read, what is dealt out, and what is kept."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quernstone.operators.bm25 import bm25_scores, ranked
from quernstone.operators.hybrid import Fusion, hybrid_scores
from quernstone.operators.index import full_postings
from quernstone.plans.answers import _that_may_fit, answer_in_turn, respond
from quernstone.plans.store import IndexStore

from .test_retrieval import ask, brute, chunks_of

ROWS = [{"terms": ["apple"] * (k % 3) + ["road", "pear"][: k % 2 + 1], "code": k % 4 == 0, "text": "apple " * (5 * k + 1)} for k in range(12)]


def counted(spark, df):
    """df, and how many of its rows have been read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema), seen


def test_bm25_reads_chunks_once(spark):
    chunks, seen = counted(spark, chunks_of(spark, *ROWS))
    found = ranked(bm25_scores(chunks, ask(spark, "apple pear apple")), chunks).collect()
    assert seen.value == len(ROWS)
    assert {r.chunk_id: r.score for r in found} == pytest.approx(brute(ROWS, ["apple", "pear", "apple"]))


def test_ranks_up_to_top(spark):
    chunks = chunks_of(spark, *ROWS)
    scores = bm25_scores(chunks, ask(spark, "apple pear"))
    every = {(r.chunk_id, r["rank"]) for r in ranked(scores, chunks).collect()}
    top = ranked(scores, chunks, top=3)
    assert {(r.chunk_id, r["rank"]) for r in top.collect()} == {x for x in every if x[1] <= 3}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["rrf", "weighted"])
def test_hybrid_leaves_texts_out_of_the_join_with_vectors(spark, method):
    rows = [r | {"v": [float(k), 1.0]} if k % 3 else r for k, r in enumerate(ROWS)]
    chunks = chunks_of(spark, *rows)
    query = ask(spark, "apple pear", vector=[1.0, 0.0])
    score = lambda df: {r.chunk_id: r.score for r in df.collect()}
    apart = chunks.where("embedding is not null").select("doc_id", "chunk_id", "start_line", "embedding")
    bare, seen = counted(spark, chunks.drop("embedding"))
    assert score(hybrid_scores(bare, query, Fusion(method), embedded=apart)) == pytest.approx(score(hybrid_scores(chunks, query, Fusion(method))))
    assert seen.value == len(ROWS)


NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)
FILES = "doc_id string, path string, content string, file_hash string"


def texts(spark, **content):
    return spark.createDataFrame([(k, f"{k}.md", v, v) for k, v in content.items()], FILES)


def test_index_reads_files_once(spark, tmp_path):
    files, seen = counted(spark, texts(spark, a="# A\n\nred brick brick", b="# B\n\nblue brick", c=""))
    store = IndexStore(spark, f"{tmp_path}/store", buckets=2)
    store.index(files, NOW)
    assert seen.value == 3
    assert {(r.doc_id, r.term): (r.tf, r.df, r.length, r.num_chunks) for r in store.postings().collect()} == {("a", "red"): (1, 1, 3, 1), ("a", "brick"): (2, 1, 3, 1), ("b", "blue"): (1, 1, 2, 1), ("b", "brick"): (1, 1, 2, 1)}
    assert {r.doc_id: r.num_chunks for r in store.list().collect()} == {"a": 1, "b": 1, "c": 0}


def test_an_emptied_document_leaves_no_chunks(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/store", buckets=1)
    store.index(texts(spark, a="# A\n\nred brick"), NOW)
    assert [r.doc_id for r in store.index(texts(spark, a=""), NOW).collect()] == ["a"]
    assert store.chunks().count() == store.postings().count() == 0 and store.get("a").first().num_chunks == 0
    store.index(texts(spark, b="# B\n\nblue brick"), NOW)
    assert {r.doc_id for r in store.documents().collect()} == {"a", "b"} and {r.content for r in store.markdown().collect()} == {"", "# B\n\nblue brick"}


def test_terms_are_dealt_out_once(spark):
    plan = full_postings(chunks_of(spark, *ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tokens", [3, 20, 70, 150, 4000])
def test_answers_in_turn_join_only_texts_that_may_fit(spark, tokens):
    chunks = chunks_of(spark, *ROWS).withColumn("doc_id", F.concat(F.lit("d"), F.col("start_line") % 20))
    query = ask(spark, "apple pear", tokens)
    found = ranked(bm25_scores(chunks, query), chunks).withColumn("max_tokens", F.lit(tokens)).drop("start_line")
    kept = [(r.doc_id, r["rank"]) for r in _that_may_fit(found, chunks).collect()]
    texts = {(r.doc_id, r.chunk_id): r.asDict() for r in chunks.collect()}
    left, parts, read = tokens, [], 0
    every = sorted(found.collect(), key=lambda r: (r.doc_id, r["rank"]))
    for doc in sorted({r.doc_id for r in every}):
        if left <= 0:
            break
        text = respond([texts[r.doc_id, r.chunk_id] for r in every if r.doc_id == doc], left)
        assert {(doc, k + 1) for k in range(text.count("### "))} <= set(kept)
        parts.append(text)
        left -= len(text.encode()) // 4
    assert answer_in_turn(chunks, query).first().answer == "\n\n---\n\n".join(parts)
    assert len(kept) < len(every) or tokens == 4000
