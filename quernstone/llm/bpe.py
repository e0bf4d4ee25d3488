"""BPE encoding and decoding over a minimal acyclic transducer.

Words of the corpus are counted over all documents; the most frequent ones (a documented parameter) are compiled, with
their ids as outputs, into a minimal acyclic automaton: equal suffixes share states, and the number of words that each
edge skips gives every word its own number, under which its ids are kept. The automaton is five flat arrays in one file
in the shared folder, which workers map into memory. Words that it lacks are merged exactly, lowest rank first."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import commit_file, new_folder, open_fs, stored, whole_text
from .tokens import Pieces, TextEncoder, load


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = [""] * 256, 0
    for b in kept:
        chars[b] = chr(b)
    for b in range(256):
        if not chars[b]:
            chars[b], extra = chr(256 + extra), extra + 1
    return chars


class Merges:
    """Exact BPE of one word at a time, and the bytes of each id, from a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.first = [vocab[c] for c in alphabet]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in vocab.items():
            if piece not in self.special:
                self.bytes[i] = bytes(back[c] for c in piece)
        for piece, i in self.special.items():
            self.bytes[i] = piece.encode()

    def encode(self, word: bytes) -> list[int]:
        if len(word) > 100:
            return self._encode_long(word)
        first, get = self.first, self.pairs.get
        ids = [first[b] for b in word]
        none = (1 << 60, 0)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == 1 << 60:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], none)
        return ids


    def _encode_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        get, ids, end = self.pairs.get, [self.first[b] for b in word], len(word)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = []

        def offer(a: int) -> None:
            if 0 <= a and (b := after[a]) < end and (found := get(ids[a] << 20 | ids[b])):
                heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))

        for k in range(end):
            offer(k)
        while heap:
            _, a, x, y, new = heapq.heappop(heap)
            if ids[a] != x or (b := after[a]) >= end or ids[b] != y:
                continue
            ids[a], ids[b], after[a] = new, -1, after[b]
            if after[a] < end:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [x for x in ids if x >= 0]


class Transducer:
    """An automaton file, mapped into memory or, where its file system can't, read; see `compile_words` for its arrays."""

    MAGIC = b"QMAT0001"

    def __init__(self, uri: str):
        filesystem, path = open_fs(uri)
        if filesystem.type_name == "local":
            with open(path, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with filesystem.open_input_stream(path) as f:
                self.map = f.read()
        if self.map[:8] != self.MAGIC:
            raise ValueError(f"{uri} is no transducer")
        edges, words, total = (int(x) for x in np.frombuffer(self.map, "<u8", 3, 8))
        at = 32
        take = lambda kind, n: np.frombuffer(self.map, kind, n, at)
        self.keys = take("<u8", edges)  # state * 256 + byte, ascending
        at += 8 * edges
        self.targets = take("<u4", edges)  # state * 2 + whether it ends a word
        at += 4 * edges
        self.skips = take("<u4", edges)  # words before those behind this edge, seen from its state
        at += 4 * edges
        self.offsets = take("<u4", words + 1)
        at += 4 * (words + 1)
        self.ids = take("<u4", total)
        self.size = words

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it; all words go one byte further at a time."""
        n = len(words)
        lengths = np.fromiter(map(len, words), "i8", n)
        out = np.full(n, -1, "i8")
        if not n or not len(self.keys):
            return out
        text, starts = np.frombuffer(b"".join(words), "u1"), np.cumsum(lengths) - lengths
        alive = np.flatnonzero(lengths > 0)
        state, number = np.zeros(n, "u8"), np.zeros(n, "i8")
        depth = 0
        while len(alive):
            key = state[alive] * np.uint64(256) + text[starts[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            alive, edge = alive[hit], edge[hit]
            target = self.targets[edge]
            number[alive] += self.skips[edge]
            state[alive] = target >> 1
            depth += 1
            done = lengths[alive] == depth
            ended = alive[done & (target & 1 > 0)]
            out[ended] = number[ended]
            alive = alive[~done]
        return out

    def spell(self, number: int) -> np.ndarray:
        """The ids of a numbered word."""
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def compile_words(words: Iterable[tuple[bytes, list[int]]], uri: str) -> int:
    """Build the minimal automaton of distinct non-empty words, given in ascending order, and write it; its edges.

    The incremental construction for sorted input: a state is frozen once no further word can change it, and is then
    replaced by an equal frozen state where there is one, so that suffixes are shared."""
    frozen: dict[tuple, int] = {}
    tables: list[tuple[tuple, bool]] = []  # of each frozen state: its edges (byte, state), whether it ends a word
    path: list[list] = [[[], False]]  # the states along the last word: edges, final
    last, offsets, ids = b"", [0], []

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            edges, final = path.pop()
            key = (tuple(edges), final)
            if key not in frozen:
                frozen[key] = len(tables)
                tables.append(key)
            path[-1][0].append((last[len(path) - 1], frozen[key]))

    for word, output in words:
        if word <= last:
            raise ValueError("words must be distinct, not empty and in ascending order")
        same = 0
        while same < len(last) and last[same] == word[same]:
            same += 1
        freeze(same)
        for _ in word[same:]:
            path.append([[], False])
        path[-1][1] = True
        last = word
        ids.extend(output)
        offsets.append(len(ids))
    freeze(0)
    tables.append((tuple(path[0][0]), False))
    root, below = len(tables) - 1, [0] * len(tables)
    for k, (edges, final) in enumerate(tables):
        below[k] = final + sum(below[t] for _, t in edges)
    name = lambda s: 0 if s == root else s + 1
    rows = []
    for k, (edges, final) in enumerate(tables):
        skip = int(final)
        for b, t in edges:
            rows.append((name(k) * 256 + b, name(t) * 2 + tables[t][1], skip))
            skip += below[t]
    rows.sort()
    filesystem, path = open_fs(f"{uri}.new")
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    with filesystem.open_output_stream(path) as f:
        f.write(Transducer.MAGIC + np.array([len(rows), len(offsets) - 1, len(ids)], "<u8").tobytes())
        for column, kind in ((0, "<u8"), (1, "<u4"), (2, "<u4")):
            f.write(np.array([r[column] for r in rows], kind).tobytes())
        f.write(np.array(offsets, "<u4").tobytes() + np.array(ids, "<u4").tobytes())
    commit_file(uri, f"{uri}.new")
    return len(rows)


class Merger:
    """Exact merges of many words at a time by the tokenizers library, without its splitter and its own table of words.

    Words stand apart by line ends, whose id no other piece gives; the few with line ends in them are merged here."""

    def __init__(self, path: str, merges: Merges):
        from tokenizers import pre_tokenizers

        self.merges, self.library = merges, load(path)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.library.model._resize_cache(0)
        self.end = merges.first[10]

    def __call__(self, words: list[str], together: int = 200) -> list[np.ndarray]:
        own = [k for k, w in enumerate(words) if "\n" in w]
        if own:
            out: list = [None if "\n" not in w else np.array(self.merges.encode(w.encode()), "u4") for w in words]
            rest = [k for k, x in enumerate(out) if x is None]
            for k, x in zip(rest, self([words[k] for k in rest]), strict=True):
                out[k] = x
            return out
        lines = ["".join(w + "\n" for w in words[k : k + together]) for k in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, "u4") for e in self.library.encode_batch_fast(lines, add_special_tokens=False)] or [np.zeros(0, "u4")])
        ends = np.flatnonzero(ids == self.end)
        if len(ends) != len(words):
            raise ValueError("the library split words otherwise than at line ends")
        return [ids[a:b] for a, b in zip([0, *(ends + 1).tolist()], ends.tolist())]


class Bpe:
    """Encodes and decodes whole texts: new words are looked up in the transducer, and merged where it lacks them."""

    def __init__(self, path: str, lexicon: str | None = None, most: int = 300_000):
        self.merges = Merges(path)
        self.merge, self.lexicon = Merger(path, self.merges), Transducer(lexicon) if lexicon else None
        self.encoder = TextEncoder(path, True, self._learn, most)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.lexicon.find([w.encode() for w in words]) if self.lexicon else np.full(len(words), -1)
        out = [self.lexicon.spell(k) if k >= 0 else None for k in numbers.tolist()]
        missing = np.flatnonzero(numbers < 0).tolist()
        for k, ids in zip(missing, self.merge([words[k] for k in missing]), strict=True):
            out[k] = ids
        return np.fromiter(map(len, out), "i8", len(out)), np.concatenate(out).astype("u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [x.astype("<u4").tobytes() for x in self.encoder.encode(texts)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Counts:
    """Counts of pieces by their hashes, and one text of each."""

    def __init__(self):
        self.keys, self.counts, self.words = [], [], []
        self.size = 0

    def add(self, pieces: Pieces) -> None:
        keys, at, counts = np.unique(pieces.hashes, return_index=True, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.words.append(pa.array(map(pieces.text, at.tolist()), pa.string()))
        self.size += len(keys)

    def rows(self) -> pa.RecordBatch:
        words = pa.concat_arrays(self.words)
        _, at, of = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        counts = np.bincount(of, np.concatenate(self.counts)).astype("i8")
        return pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(counts)], ["word", "n"])


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", flush: int = 600_000, together: int = 1 << 20) -> DataFrame:
    """(word, n) over all documents; each task adds up before it hands on. Texts that the library must cut (see tokens)
    are cut by it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, odd = TextEncoder(tokenizer, True, None, 1), _Counts(), Counter()
        for batch in batches:
            some, size = [], 0
            for k in range(batch.num_rows):
                text = batch.column(0)[k].as_py()
                if encoder.plain(text):
                    some.append(text)
                    size += len(text)
                else:
                    odd.update(text[a:b] for _, (a, b) in encoder.tokenizer.pre_tokenizer.pre_tokenize_str(text))
                if some and (size > together or k == batch.num_rows - 1):
                    counts.add(Pieces(some, True))
                    some, size = [], 0
                if counts.size > flush:
                    yield counts.rows()
                    counts = _Counts()
                if len(odd) > flush:
                    yield _counted(odd)
                    odd = Counter()
        if counts.size:
            yield counts.rows()
        if odd:
            yield _counted(odd)

    found = docs.select(whole_text(text_col).alias("t")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = 1 << 17, text_col: str = "text") -> str:
    """Compile the most frequent words of the documents (at most `words`; of equally frequent ones all or none) into a
    transducer in the shared folder; its URI. The words are counted over all documents; only the lexicon comes to the
    driver, once the least count that keeps it within `words` is known, and what it leaves out is merged exactly, so
    its size sets speed and not results."""
    counts = stored(word_counts(docs, tokenizer, text_col).where("n > 1"), "words")
    up_to = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    levels = counts.groupBy("n").agg(F.count("*").alias("c")).select("n", F.sum("c").over(up_to).alias("c"))  # a row a count
    least = levels.where(F.col("c") <= words).agg(F.min("n")).first()[0]
    merges = Merges(tokenizer)
    some = sorted(r[0].encode() for r in counts.where(F.col("n") >= least).select("word").collect()) if least else []
    uri = new_folder(docs.sparkSession, "lexicon") + "/words"
    compile_words(((w, merges.encode(w)) for w in some if w), uri)
    return uri


_READY: dict[tuple[str, str | None], Bpe] = {}


def worker_bpe(tokenizer: str, lexicon: str | None) -> Bpe:
    """One encoder per Python worker."""
    if (tokenizer, lexicon) not in _READY:
        _READY.clear()
        _READY[tokenizer, lexicon] = Bpe(tokenizer, lexicon)
    return _READY[tokenizer, lexicon]


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text", step: int = 256) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, decoded text) of every row's whole text.

    Null texts are empty; null and repeated ids pass through; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer, lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                ids = bpe.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, words: int = 1 << 17) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as unsigned 32-bit integers), decoded_sha256 (of the text
    that decoding the ids gives), taken beside the encoder. Null texts are empty; null and repeated ids pass through, a row
    each; other columns are ignored; an empty table gives none."""
    lexicon = build_lexicon(docs, tokenizer, words)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer, lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = bpe.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
