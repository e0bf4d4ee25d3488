"""Operators 1, 4 and 7, and the pipeline, against brute force, round trips and held-out accuracy."""

import base64
import gzip
import io
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import warc
from quernstone.llm.common import open_fs
from quernstone.llm.htmltext import Labeller, blocks, extract, main_texts
from quernstone.llm.htmltrain import accuracy
from quernstone.llm.minhash import Words, shingles, similar
from quernstone.llm.tokens import load
from quernstone.llm.toxicity import DECAY, SPAN, Machine, below, fit, nystroem, score, toxicity_scores, triples

PAGES = "page_id long, url string, html string, payload string, kind int, hex string, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "h", "t") for r in rows], PAGES).repartition(3)


# WARC


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/ b\r\n", "<p>one"), (2, None, "<p>one"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", "<p>one"), (7, "", "\r\n\r\nWARC/1.1\r\n")]


def test_warc_digests(spark):
    got = {r.page_id: r for r in warc.warc_digests(pages_of(spark, ROWS)).collect()}
    last = {}
    for i, _, html in ROWS:
        last[html or ""] = max(i, last.get(html or "", 0))
    for i, _, html in ROWS:
        r, keeper = got[i], last[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), sha(html))
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == i else ("revisit", keeper))
    assert warc.warc_digests(pages_of(spark, ROWS).limit(0)).collect() == []


def test_warc_of_odd_rows(spark):
    rows = [(None, "u", "x"), (None, "u", "x"), (8, "u", "x"), (8, "u", "x"), (9, "u", "yy"), (7, "u", "yy")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.warc_digests(pages_of(spark, rows)).collect())
    assert got == [(0, "response", None), (0, "response", None), (7, "revisit", 9), (8, "response", None), (8, "revisit", 8), (9, "response", None)]
    # short payloads are all responses
    manifest = warc.write_warc(pages_of(spark, rows), warc.new_folder(spark, "test"), min_bytes=2)
    assert sorted(r.refers_to or 0 for r in warc.read_warc(manifest).collect()) == [0, 0, 0, 0, 0, 9]


def test_warc_rolls_and_repeats_itself(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"u{k}", "".join(rng.choice("abcdefgh") for _ in range(3000))) for k in range(80)]
    whole = []
    for name in ("a", "b"):
        files = sorted(r.file for r in warc.write_warc(pages_of(spark, rows), f"file://{tmp_path}/{name}", roll_bytes=9000).collect())
        whole.append([open(open_fs(f)[1], "rb").read() for f in files])
        ids = []
        for data in whole[-1]:
            with gzip.open(io.BytesIO(data)) as stream:
                ids += [int(h["warc-record-id"].split(":")[-1][:-1]) for h, _ in warc.parse(stream) if h["warc-type"] != "warcinfo"]
        assert ids == list(range(80)) and len(files) > 8
    assert whole[0] == whole[1]


# HTML


def test_blocks():
    page = "<body><nav><a href=/x>Home</a></nav><p>A &amp; <b>b</b>\n c<p>Two&nbsp;<script>var x='<p>no'</script>z<div>in</div><!-- gone --></body>"
    assert [(t, [x for x, _ in p][-1], n > 0) for p, t, n in blocks(page)] == [("Home", "nav", True), ("A & b c", "p", False), ("Two z", "p", False), ("in", "div", False)]
    assert blocks("") == [] and [t for _, t, _ in blocks("<unclosed " + "x" * 9)] == [] and blocks("<!-- <p>x")  == []


def test_labeller_on_pages_it_has_not_seen():
    assert accuracy({k: v for k, v in Labeller.load().w.items()}, 150, 4321) > 0.96


def test_extract(spark):
    word = lambda k: f"Sentence number {k} tells of things, at some length, for readers."
    junk = "<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{junk}<article><h1>Head line</h1><p>{word(1)}\n\t{word(2)}</p><p>{word(3)} &lt;x&gt;</p></article><div class=comments><p>Nice post, thanks!</p></div><footer>&copy; 2024 Site</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<script>x</script>"), (5, "u", page)]
    got = {r.page_id: r for r in extract(pages_of(spark, rows)).collect()}
    assert got[1].text == f"Head line\n\n{word(1)} {word(2)}\n\n{word(3)} <x>" == got[5].text
    assert got[1].n_chars == len(got[1].text) and got[2].url is None
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (2, 3, None))
    assert extract(pages_of(spark, rows).limit(0)).collect() == []
    assert main_texts([page, "", page])[1] == ""


# toxicity

INSULTS = "blorgon snarvid quexil drumpelt".split()


def spoilt(rng, word):
    """The word with a sign or a letter put in, or as it is."""
    k, x = rng.randrange(1, len(word)), rng.random()
    return word if x < 0.5 else word[:k] + rng.choice("x.*-") + word[k:]


def labelled_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "mi", "lo", "ne", "ru", "ki", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    out = []
    for _ in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(3, 90))], rng.random() < 0.3
        for _ in range(rng.randint(1, 3) * bad):
            text.insert(rng.randrange(len(text)), spoilt(rng, rng.choice(INSULTS)))
        out.append((" ".join(text).capitalize() + ".", int(bad)))
    return out


def test_machine_on_held_out_texts():
    train, rest = labelled_texts(900, 1), labelled_texts(500, 2)
    machine = fit([t for t, _ in train], [y for _, y in train])
    said = machine.scores([t for t, _ in rest]) >= 0.7
    y = np.array([y for _, y in rest], bool)
    assert said[y].mean() > 0.95 and (~said[~y]).mean() > 0.98
    assert fit(["a b c"], [0]) is None and fit([], []) is None
    assert ((0 <= machine.scores(["", "x" * 5000, "🙂"])) & (machine.scores(["", "x" * 5000, "🙂"]) <= 1)).all()


def subsequence_kernel(a, b):
    """Over triples of characters in order, with gaps, by plain enumeration; normalised."""

    def feature(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + SPAN)):
                    key = (w[i], w[j], w[k])
                    out[key] = out.get(key, []) + [DECAY ** (k - i + 1)]
        return out

    x, y = feature(a), feature(b)
    norm = lambda f: sum(v * v for vs in f.values() for v in vs) ** 0.5
    return sum(sum(x[k]) * sum(y[k]) for k in x.keys() & y.keys()) / norm(x) / norm(y)


def test_kernel_and_nystroem_map_equal_brute_force():
    words = ["stupid", "stuxpid", "s", "clown", "clowns", "banana", "ab", "日本語", "aaaaaaa"]
    number, hashes, weights = triples(words)
    dense = np.zeros((len(words), 1 << 21), "f4")
    np.add.at(dense, (number, hashes), weights)
    brute = np.array([[subsequence_kernel(a, b) for b in words] for a in words])
    assert np.abs(dense @ dense.T - brute).max() < 1e-5 and brute[0, 1] > 0.3 > brute[0, 3]
    # inner products of maps are the kernel between landmarks, and its projection for other words
    _, place, z, root = nystroem(words[:6])
    kernel = np.array([[subsequence_kernel(a, b) for b in words[:6]] for a in words])
    maps = kernel @ root
    assert np.abs(maps[:6] @ maps[:6].T - brute[:6, :6]).max() < 1e-5
    assert np.abs(z @ z.T - brute[:6, :6]).max() < 1e-5
    w = np.random.default_rng(1).standard_normal(6)
    table = np.zeros(1 << 21)
    table[np.flatnonzero(place >= 0)] = z.T @ (root @ w)
    assert np.abs(Machine(table, 0.5, 1.0, 0.0).words(words) - (maps @ w + 0.5)).max() < 1e-5


def test_toxicity_scores(spark):
    texts = labelled_texts(600, 3)
    docs = spark.createDataFrame([(k, t, "l", 0, 1.0) for k, (t, _) in enumerate(texts)] + [(None, None, "l", 0, 1.0), (999, "", "l", 0, 1.0)], "doc_id long, text string, lang string, toxic int, score double").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity_scores(docs, labels).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(rows) == len(texts) + 2
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == texts[r.doc_id][1] for r in held]) > 0.95
    # labels of held-out rows don't matter
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity_scores(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    assert {r.score for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    scored = score(docs, Machine(np.zeros(1 << 21), -1.0, 1.0, 0.0))
    assert scored.columns == ["doc_id", "text", "lang", "toxic", "score"] and scored.where("score > 0.5").isEmpty()
    assert scored.where("text is null").count() == 1
    low = Machine(np.zeros(1 << 21), 0.0, 1.0, 0.0)  # texts with words score 0.5, those without less
    assert sorted(r.doc_id or -1 for r in below(docs, low, 0.4).collect()) == [-1, 999] and below(docs, None, 0.4).columns == docs.columns


# pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 99)) for _ in range(rng.randint(6, 12))).capitalize() + "." for _ in range(n))
    rows, labels = {}, {}

    def add(text, label=None):
        rows[len(rows)] = text
        if label is not None:
            labels[len(rows) - 1] = label
        return len(rows) - 1

    for text, y in labelled_texts(500, 4):
        add(text + " " + prose(2), y)
    clean = [add(prose(12)) for _ in range(30)]
    copied = [add(rows[clean[0]]), add(rows[clean[1]] + " One word.")]
    passage = prose(9)
    with_passage = [add(f"{prose(6)} {passage} {prose(6)}") for _ in range(4)]
    item = " ".join(f"q{k}" for k in range(20))
    leaked = [add(f"{prose(5)} {item} {prose(5)}"), add(f"{prose(5)} {item.replace('q7', 'z')} {prose(5)}")]
    empty = [add(""), add(None)]
    long = add(prose(3000))
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        after[name] = {r.doc_id: r.text if "text" in docs.columns else r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {k for k, y in labels.items() if y}
    assert len(toxic & after["toxicity"].keys()) < 0.05 * len(toxic) and set(range(500, len(rows))) <= after["toxicity"].keys()
    assert not set(copied) & after["near_dedup"].keys() and {*clean, *with_passage, *leaked, long, empty[0]} <= after["near_dedup"].keys()
    cut = after["substring_dedup"]
    assert cut.keys() == after["near_dedup"].keys() and all(cut[k] == rows[k] for k in [*clean, long])
    assert passage in cut[with_passage[0]] and all(passage[20:-20] not in cut[k] and len(cut[k]) > 100 for k in with_passage[1:])
    assert after["decontaminate"].keys() == cut.keys() - set(leaked)
    tokenizer = load(public_tokenizers.path("byte_bpe_50k.json"))
    for k, r in after["bpe"].items():
        ids = tokenizer.encode(cut[k] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert after["bpe"].keys() == after["decontaminate"].keys()
    words, bags = Words(), {}
    for k in clean:
        bags[k] = shingles(words.hashes(re.sub(r"\s+", " ", rows[k])), 5)
    assert not any(similar(bags[a], bags[b], 0.8) for a in clean for b in clean if a < b)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect() == []


@pytest.mark.parametrize("odd", ["<svg width='1'/>", "<svg>", "<math/>", "<button>", "<select>", "<object>", "<canvas>", "<noscript>", "<template>"])
def test_text_after_odd_elements_stays(odd):
    found = " ".join(t for _, t, _ in blocks(f"<p>before {odd} after</p><p>more</p><button>go</button><svg><text>drawn</text></svg><p>x is <math><mi>y</mi></math></p>"))
    assert all(w in found.split() for w in ("before", "after", "more", "x", "y")) and "drawn" not in found
