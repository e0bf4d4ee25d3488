"""Operators 5, 9 and 10 against the tokenizers library and plain brute force."""

import hashlib
import heapq
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm.bpe import Bpe, Merges, Transducer, bpe_digests, compile_words, encode_documents
from quernstone.llm.common import components, open_fs, ranked
from quernstone.llm.records import frame, read_frame, read_record, token_digests, write_token_records
from quernstone.llm.sharding import lpt, shard_documents
from quernstone.llm.tokens import TextEncoder, WordMerger, load, word_encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "Hello  World\n\n it's  I'LL don't", "Éçole ñandú ÇA Straße ǅ", "x" * 3000, "ab1" * 400 + "lorem" * 300, "a b c\x1cd \x85e", "123 4½²³ IV Ⅳ ٣",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|startoftext|>", "日本語 текст 🙂🙂 ﬁ", "é İstanbul ΣΑΣ ς", "\t\n  tail  ", "'s'T're !!! ...\r\n", "ab " * 2000,
]


def schema(rows):
    return "doc_id long, text string, _part string, t string, size int, rank int, word string"


def frame_of(spark, texts):
    return spark.createDataFrame([(i, t, "p", "t", 1, 2, "w") for i, t in enumerate(texts)], schema(None)).repartition(3)


def test_cached_words_equal_library():
    tokenizer = load(WORD)
    small = TextEncoder(WORD, False, WordMerger(WORD), most=10)
    for _ in range(3):
        for together in (1, 1 << 20):
            for got, text in zip(small.encode(TEXTS, together), TEXTS, strict=True):
                assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_with_apostrophes_and_spaces():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["'", "'s", "'ll", "'re", " ", "  ", "\n", "\t ", "a", "Bc", "1", "23", "é", ".", "!?", "\x00", "\xa0"]) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for path, encode in ((WORD, _cached().encode), (BYTE, lambda x: [np.frombuffer(b, "<u4") for b in _bpe().encode(x)])):
        tokenizer = _library(path)
        for got, text in zip(encode(texts), texts, strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_both_encoders_on_any_text(texts):
    for path, encode in ((WORD, _cached().encode), (BYTE, lambda x: [np.frombuffer(b, "<u4") for b in _bpe().encode(x)])):
        tokenizer = _library(path)
        for got, text in zip(encode(texts), texts, strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


_made = {}


def _cached():
    return _made.setdefault("c", word_encoder(WORD))


def _bpe():
    return _made.setdefault("b", Bpe(BYTE))


def _library(path):
    return _made.setdefault(path, load(path))


def test_frames_find_damage():
    data = frame(b"abc") + frame(b"")
    f = io.BytesIO(data)
    assert (read_frame(f), read_frame(f), read_frame(f)) == (b"abc", b"", None)
    for k in range(len(frame(b"abc"))):
        bad = bytearray(frame(b"abc"))
        bad[k] ^= 1
        with pytest.raises(ValueError):
            read_frame(io.BytesIO(bytes(bad)))


def test_token_records(spark):
    texts = [*TEXTS, None, "tie", "tie"]
    tokenizer, want, start = load(WORD), {}, 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_digests(frame_of(spark, texts), WORD).collect()}
    assert got == want
    assert token_digests(frame_of(spark, texts).limit(0), WORD).collect() == []


def test_token_records_of_null_ids(spark):
    rows = [(0, "zero"), (None, "beta gamma"), (-5, "minus"), (None, None), (None, "alpha")]
    tokenizer, want, start = load(WORD), [], 0
    for doc_id, t in [(None, None), (None, "alpha"), (None, "beta gamma"), (-5, "minus"), (0, "zero")]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_digests(docs, WORD).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_record_index(spark, tmp_path):
    manifest = [m.asDict() for m in write_token_records(frame_of(spark, TEXTS), f"file://{tmp_path}/r", WORD, 2).collect()]
    tokenizer, seen = load(WORD), 0
    for m in manifest:
        for k in reversed(range(m["records"])):
            doc_id, ids = read_record(m["file"], m["index"], k)
            assert ids.tolist() == [*tokenizer.encode(TEXTS[doc_id], add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == len(TEXTS)


def test_bpe_digests(spark):
    texts = [*TEXTS, None, *TEXTS]
    tokenizer = load(BYTE)
    for words in (0, 5, 1000):
        got = {r.doc_id: r for r in bpe_digests(frame_of(spark, texts), BYTE, words).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digests(frame_of(spark, texts).limit(0), BYTE).collect() == []
    assert [r.decoded for r in encode_documents(frame_of(spark, texts), BYTE).orderBy("doc_id").collect()] == [t or "" for t in texts]


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    outputs = {w: [rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for w in words}
    edges = compile_words(((w, outputs[w]) for w in words), str(tmp_path / "m"))
    lexicon = Transducer(str(tmp_path / "m"))
    asked = [*words, *(w + b"a" for w in words), b"", b"zz", *(w[:-1] for w in words)]
    for w, got in zip(asked, lexicon.find(asked).tolist(), strict=True):
        assert (None if got < 0 else lexicon.spell(got).tolist()) == outputs.get(w), w
    # minimal: as many edges as there are (right language, byte) pairs
    rights = {}
    for w in words:
        for k in range(len(w) + 1):
            rights.setdefault(w[:k], set()).add(w[k:])
    classes = {frozenset(v) for v in rights.values()}
    assert edges == sum(len({x[:1] for x in c if x}) for c in classes)
    compile_words([], str(tmp_path / "e"))
    assert Transducer(str(tmp_path / "e")).find([b"a", b""]).tolist() == [-1, -1]


def test_merges_decode_every_id():
    merges, tokenizer = Merges(BYTE), load(BYTE)
    for i in random.Random(2).sample(range(50257), 500):
        assert merges.bytes[i].decode("utf-8", "replace") == tokenizer.decode([i], skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 6))
def test_lpt_equals_heap(sizes, shards):
    heap, loads = [(0, j) for j in range(shards)], Counter()
    for s in sorted(sizes, reverse=True):
        load_, j = heapq.heappop(heap)
        heapq.heappush(heap, (load_ + s, j))
        loads[j] += s
    runs = sorted(Counter(sizes).items(), reverse=True)
    got = Counter()
    ranks = {}
    for s, low, high, j in lpt(runs, shards):
        got[j] += s * (high - low)
        ranks.setdefault(s, []).extend(range(low, high))
    assert sorted(got[j] for j in range(shards)) == sorted(loads[j] for j in range(shards))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in runs}


def test_shards(spark):
    rng = random.Random(3)
    texts = ["same"] * 300 + ["é" * rng.randint(0, 30) for _ in range(200)] + [f"{k:03d}" for k in range(300)] + [None, "", None]
    rows = shard_documents(frame_of(spark, texts), 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    shard_of, slots, loads = {}, {}, Counter()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(raw, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for t in texts:
        groups[(t or "").encode()] += len((t or "").encode()) + 8
    heap = [0] * 5
    for s in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    assert sorted(loads.values()) == sorted(heap)
    assert shard_documents(frame_of(spark, texts).limit(0), 5).collect() == []
    assert shard_documents(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), 5).count() == 2


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] + [(7, 7)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    for r in ranked(df, ["k"], ["o"], "n", "t").collect():
        assert r.n == r.o // 3
    assert open_fs("/tmp/x")[1] == open_fs("file:///tmp/x")[1] == "/tmp/x"
