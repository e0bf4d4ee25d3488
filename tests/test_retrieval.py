"""Chunking, term statistics, ranking, fusion and excerpts, against fixed expectations."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions.text import STOPWORDS, approx_tokens, normalize_terms, path_id, strip_html, trim_ws, url_id
from quernstone.functions.vector import cosine
from quernstone.operators.bm25 import bm25_scores, ranked
from quernstone.operators.chunker import chunk, chunk_in_python, chunk_rows
from quernstone.operators.excerpt import NOTHING_ANYWHERE, TOO_SMALL, answers, budgeted
from quernstone.operators.hybrid import Fusion, hybrid_scores
from quernstone.operators.index import doc_freq_map, postings, term_stats
from quernstone.plans.answers import answer_in_turn, answer_ranked, respond

FENCE = "```"
GUIDE = "\n".join(
    ["# Guide to Streams", "", "Intro line about brokers.", "", "## Setup", "", "Install the broker first.", "", "## Readers", "", "A reader keeps its place in a stream.", "It can resume later.", "", "### Durable Readers", "", "Durable readers keep state.", "", FENCE + "go", "open(stream)", "# no heading", "| no | row |", FENCE, "", "| Key | Kind |", "| --- | :-: |", "| name | text |", ""]
)
CASES = {
    "guide": (GUIDE, 120, 12),
    "lines": ("\n".join(f"Line {k} content" for k in range(20)), 5, 2),
    "run": (f"a\n\n\n\n{FENCE}\nx\n{FENCE}\n\nb\n", 120, 12),
    "unclosed": (f"a\n{FENCE}go\n" + "x\n" * 9 + "# H\n", 5, 2),
    "heads": ("".join(f"# H{k}\n" for k in range(8)) + "text", 5, 12),
    "odd": (f"##   \n#\x0bT\n# a b\n{FENCE}c++\n  {FENCE}\n~~~\n####### seven\n#none\n\x85\n|a|\n | - | :b |\n　| c　|\n", 4, 1),
    "empty": ("", 120, 12),
    "blank": ("\n\n \n\t\n\n\n", 120, 12),
    "null": (None, 120, 12),
}


@pytest.mark.parametrize("name", CASES)
def test_fold_equals_python(spark, name):
    content, most, least = CASES[name]
    docs = spark.createDataFrame([("d", "x/f.md", content)], "doc_id string, path string, content string")
    got = [r.asDict(recursive=True) for r in chunk(docs, most, least).orderBy("start_line").collect()]
    want = chunk_rows("x/f.md", content or "", most, least)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        w = w | {"code_blocks": [{"language": a, "code": b, "line": c} for a, b, c in w["code_blocks"]], "table_rows": [{"cells": a, "line": b} for a, b in w["table_rows"]]}
        assert {k: g[k] for k in w} == w
        assert g["chunk_id"] == f"d:{w['start_line']}-{w['end_line']}"


def test_fold_equals_python_on_many(spark):
    import random

    rng = random.Random(5)
    kinds = ["", "", " ", "text here", "# One", "## Two ", "#### Deep", FENCE, FENCE + "py", "| a | b |", "|---|:-|", "\t"]
    rows = [(f"d{k}", f"p/{k}.md", "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id string, path string, content string")
    columns = ["doc_id", "start_line", "end_line", "title", "heading_path", "text", "has_code"]
    key = lambda r: (r.doc_id, r.start_line)
    assert sorted(chunk(docs, 9, 3).select(columns).collect(), key=key) == sorted(chunk_in_python(docs, 9, 3).select(columns).collect(), key=key)


def test_expected_boundaries():
    spans = lambda name: [(c["start_line"], c["end_line"], c["title"]) for c in chunk_rows("f.md", *CASES[name])]
    assert spans("lines") == [(1, 5, "f.md"), (6, 10, "f.md"), (11, 15, "f.md"), (16, 20, "f.md")]
    assert [s[:2] for s in spans("run")] == [(1, 8), (9, 10)]
    assert spans("unclosed") == [(1, 13, "f.md")]
    assert spans("heads") == [(1, 9, "H7")]


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "terms"),
    [("Hello World", ["hello", "world"]), ("The consumer is configured", ["consumer", "configured"]), ("Using the example following", []), ("", []), (None, []), ("a<br>b1 İstanbul café x_y", ["ab1", "istanbul", "caf", "x_y"]), ("fox fox", ["fox", "fox"])],
)
def test_terms(spark, text, terms):
    assert column(spark, text, normalize_terms) == terms


def test_text_functions(spark):
    assert len(STOPWORDS) == 82
    assert column(spark, "a&amp;nbsp;b &lt;i&gt; &copy;<p>c", strip_html) == "ab <i> c"
    assert column(spark, "　\x85 a b\n\x0b", trim_ws) == "a b"
    assert [column(spark, t, approx_tokens) for t in ("", "word", "hello world this is a test", "é")] == [0, 1, 7, 1]
    assert (path_id("/path/to/doc.md"), path_id("/docs/nats.md"), url_id("https://docs.nats.io/jetstream")) == ("82ec731ce0adacc8", "82f8693eddb09b26", "612726fcbc8c33e7")


@pytest.mark.parametrize(("a", "b", "want"), [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([1, 2, 3], [1, 2, 3], 1), ([1], [1, 2], 0), ([], [], 0), ([0, 0], [1, 1], 0), (None, [1], 0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a and list(map(float, a)) if a is not None else None, list(map(float, b)))], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first().c == pytest.approx(want, abs=1e-6)


CHUNK = "doc_id string, chunk_id string, path string, title string, heading_path array<string>, start_line int, end_line int, text string, has_code boolean, terms array<string>, embedding array<float>"


def chunks_of(spark, *rows):
    return spark.createDataFrame([("d", f"c{k}", "p.md", f"T{k}", [], k * 10 + 1, k * 10 + 10, r.get("text", "x"), r.get("code", False), r["terms"], r.get("v")) for k, r in enumerate(rows)], CHUNK)


def ask(spark, prompt, tokens=500, vector=None):
    return spark.createDataFrame([(0, prompt, tokens, vector)], "query_id int, prompt string, max_tokens int, vector array<float>")


def brute(rows, prompt):
    n, mean = len(rows), sum(len(r["terms"]) for r in rows) / len(rows)
    out = {}
    for k, r in enumerate(rows):
        s = 0.0
        for t in prompt:
            df = sum(t in x["terms"] for x in rows)
            if df:
                tf = r["terms"].count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r["terms"]) / mean))
        if s > 0:
            out[f"c{k}"] = s * (1.2 if r.get("code") else 1)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("alpha beta gamma delta".split()), max_size=6), min_size=1, max_size=5), st.lists(st.sampled_from("alpha beta zeta".split()), min_size=1, max_size=4))
def test_bm25_equals_brute_force(spark, terms, prompt):
    rows = [{"terms": t, "code": k % 2 == 0} for k, t in enumerate(terms)]
    if any(t for t in terms):
        got = {r.chunk_id: r.score for r in bm25_scores(chunks_of(spark, *rows), ask(spark, " ".join(prompt))).collect()}
        assert got == pytest.approx(brute(rows, prompt))


def test_term_tables(spark):
    posted = postings(chunks_of(spark, {"terms": ["ab", "ab", "cd"]}, {"terms": ["ab"]}, {"terms": []}))
    assert doc_freq_map(term_stats(posted)).first().doc_freq == {"ab": 2, "cd": 1}


def test_fusion(spark):
    rows = chunks_of(spark, {"terms": ["apple", "fruit"], "v": [1.0, 0.0]}, {"terms": ["car", "road"], "v": [0.0, 1.0]})
    query = ask(spark, "apple", vector=[1.0, 0.0])
    score = lambda f: {r.chunk_id: r.score for r in hybrid_scores(rows, query, f).collect()}
    assert score(Fusion("rrf")) == pytest.approx({"c0": 2 / 61, "c1": 1 / 62})
    assert score(Fusion("weighted")) == pytest.approx({"c0": 1.0, "c1": 0.35})
    assert score(Fusion("unknown")) == score(Fusion())
    bare = chunks_of(spark, {"terms": ["apple", "fruit"]}, {"terms": ["car"], "v": []})
    assert {r.chunk_id for r in hybrid_scores(bare, query).collect()} == {"c0"}
    mixed = chunks_of(spark, {"terms": ["apple", "fruit"]}, {"terms": ["car"], "v": [1.0, 0.0]})
    assert {r.chunk_id: r.score for r in hybrid_scores(mixed, query, Fusion("weighted")).collect()} == pytest.approx({"c0": 0.3, "c1": 0.7})
    # words without weight leave the ranking to the embeddings
    assert {r.chunk_id for r in hybrid_scores(rows, ask(spark, "the of", vector=[1.0, 0.0])).collect()} == {"c0", "c1"}


def answer(spark, rows, tokens, parity=True):
    c = chunks_of(spark, *rows)
    found = ranked(bm25_scores(c, ask(spark, "apple")), c).withColumn("max_tokens", F.lit(tokens)).drop("start_line")
    r = answers(budgeted(found, c, parity)).first()
    same = sorted((x.asDict() for x in c.collect()), key=lambda x: x["chunk_id"])
    order = [r.chunk_id for r in found.orderBy("rank").collect()]
    assert r.answer == respond([next(x for x in same if x["chunk_id"] == k) for k in order], tokens, parity)
    return r.answer


def test_budget(spark):
    small = [{"terms": ["apple"] * (5 - k), "text": f"apple {k} " * 10} for k in range(4)]
    assert answer(spark, small, 60).count("###") == 2
    assert answer(spark, small, 500).count("\n--------------------------------\n\n") == 3
    long = [{"terms": ["apple"], "text": "word " * 400}]
    assert answer(spark, long, 200) == TOO_SMALL
    assert "…" in answer(spark, long, 200, parity=False)
    assert "…" in answer(spark, [{"terms": ["apple"], "text": "é" * 900}], 200)


def test_all_documents(spark):
    c = chunks_of(spark, *[{"terms": ["apple"], "text": f"apple pie {k}"} for k in range(3)]).withColumn("doc_id", F.concat(F.lit("d"), F.col("start_line")))
    text = answer_in_turn(c, ask(spark, "apple")).first().answer
    assert text.count("\n\n---\n\n") == 2 and text.index("pie 0") < text.index("pie 1") < text.index("pie 2")
    assert answer_in_turn(c, ask(spark, "apple", 16)).first().answer.count("###") == 1
    assert answer_ranked(c, ask(spark, "apple")).first().answer.count("###") == 3
    for every in (answer_in_turn, answer_ranked):
        assert every(c, ask(spark, "zebra")).first().answer == NOTHING_ANYWHERE
