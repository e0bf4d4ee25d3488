"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling.

An item of n words is looked for in every document within k = floor(n / 5) word edits. CGK walks along a window of words:
step j hands out the word that the walk stands on and goes on to the next one or not, by a random function of j and the
word; so windows at a small edit distance come out at a small Hamming distance. Repeated sampling of a few places of the
walk's output is a locality-sensitive hash: the items' samples are the index, in which an item-sized window's samples find
the items that it may hold; these are verified by the exact edit distance.

Which windows are hashed is decided without loss: of k + 1 pieces of an item, k edits leave one whole, so a window of a
length is passed over only if no piece of any item of that length stands where it could."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, whole_text
from .minhash import Words

WALKS, SAMPLES, BITS = 8, 40, 3
_G = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 22
#: Where samples are taken: shares of the walk's part that no walk leaves empty.
_SHARES = np.random.default_rng(0).random((WALKS, SAMPLES, BITS))
_TURNS = mix(np.arange(1, 1 << 12, dtype="u8") * _G) | np.uint64(1)


def edits_allowed(n: int) -> int:
    return n // 5


def reach(n: np.ndarray) -> np.ndarray:
    """The steps of a walk over n words that samples are taken from."""
    return np.maximum(1, 8 * n // 5)


def cgk(windows: np.ndarray, lengths: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """The output of each row's walk over its first `lengths` words (hashes; zeros after the end), as far as it is sampled."""
    steps, rows = int(reach(lengths).max()), np.arange(len(windows))
    padded = np.hstack([windows, np.zeros((len(windows), 1), "u8")])
    flat, row = padded.ravel(), rows * padded.shape[1]
    at, end = row.copy(), row + lengths
    turns = _TURNS if steps * WALKS <= len(_TURNS) else mix(np.arange(1, steps * WALKS + 1, dtype="u8") * _G) | np.uint64(1)
    out = np.empty((len(windows), steps), "u8")
    for j in range(steps):
        word = flat[at]
        out[:, j] = word
        at += (word * turns[j * WALKS + walks] >> np.uint64(63)).astype("i8")
        np.minimum(at, end, out=at)
    return out


def samples(walked: np.ndarray, lengths: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """SAMPLES keys of each walk, each of BITS places; windows of other lengths and other walks have other keys."""
    places = (_SHARES[walks] * reach(lengths)[:, None, None]).astype("i8")
    keys = mix((lengths * WALKS + walks).astype("u8")[:, None] * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype="u8"))
    rows = np.arange(len(walked))[:, None]
    for k in range(BITS):
        keys = mix(keys ^ walked[rows, places[:, :, k]]) + _G
    return keys


def all_samples(windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys of all walks over each window."""
    walks = np.tile(np.arange(WALKS), len(windows))
    windows, lengths = np.repeat(windows, WALKS, axis=0), np.repeat(lengths, WALKS)
    return samples(cgk(windows, lengths, walks), lengths, walks).reshape(-1, WALKS * SAMPLES)


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    sums = np.full(max(0, len(words) - q + 1), q, "u8")
    for k in range(q):
        sums = (sums ^ words[k : len(words) - q + 1 + k]) * _G
        sums ^= sums >> np.uint64(29)
    return mix(sums)


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of words, where the first such stretch ends)."""
    m = len(words)
    row, steps = np.zeros(m + 1, "i8"), np.arange(m + 1)
    for k, w in enumerate(item, 1):
        new = np.empty(m + 1, "i8")
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Lookup:
    """Keys to rows of numbers: sorted, behind a bitmap that most keys don't pass."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.columns = keys[order], [c[order] for c in columns]
        self.bits = np.zeros(1 << _FILTER, bool)
        self.bits[keys >> np.uint64(64 - _FILTER)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in keys, columns...) of every row whose key is among the keys."""
        on = np.flatnonzero(self.bits[keys >> np.uint64(64 - _FILTER)])
        low, high = (np.searchsorted(self.keys, keys[on], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(on, n), *(c[at] for c in self.columns)


class Items:
    """A block of benchmark items: the index of their samples, and their pieces by the pieces' length."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = Words()
        self.items = [(i, h) for i, t in rows if len(h := words.hashes(t or ""))]
        self.longest = max((len(h) for _, h in self.items), default=0)
        pieces: dict[int, set[tuple[int, int, int]]] = {}
        keys = []
        for lo in range(0, len(self.items), 256):
            some = [h for _, h in self.items[lo : lo + 256]]
            for h in some:
                n, parts = len(h), edits_allowed(len(h)) + 1
                q = min(4, n // parts)
                at = [p * n // parts for p in range(parts)]
                grams = _grams(h, q)
                pieces.setdefault(q, set()).update((int(grams[a]), n, a) for a in at)
            windows = np.zeros((len(some), max(map(len, some))), "u8")
            for row, h in zip(windows, some, strict=True):
                row[: len(h)] = h
            keys.append(all_samples(windows, np.array([len(h) for h in some])))
        self.index = Lookup(np.concatenate(keys).ravel(), np.repeat(np.arange(len(self.items)), WALKS * SAMPLES)) if keys else None
        self.pieces = {}
        for q, found in pieces.items():
            key, n, at = zip(*sorted(found), strict=True)
            self.pieces[q] = Lookup(np.array(key, "u8"), np.array(n), np.array(at))

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """Of each text's words: (item id, edits, word at which the verified stretch's window begins) of its items."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        gap = np.zeros(self.longest, "u8")
        lengths = np.fromiter(map(len, texts), "i8", len(texts))
        opens = np.cumsum(lengths + self.longest) - lengths
        words = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
        doc, n, start = self._windows(words, opens, lengths)
        found = []
        for lo in range(0, len(doc), 2048):
            some = slice(lo, lo + 2048)
            columns = np.arange(n[some].max())
            windows = np.where(columns < n[some, None], words[np.minimum(start[some, None] + columns, len(words) - 1)], 0)
            place, item = self.index.find(all_samples(windows, n[some]).ravel())
            found.append(np.unique((place // (WALKS * SAMPLES) + lo) * len(self.items) + item))
        hits: dict[tuple[int, int], list[int]] = {}
        for x in np.concatenate(found).tolist() if found else ():
            row, item = divmod(x, len(self.items))
            hits.setdefault((int(doc[row]), item), []).append(int(start[row] - opens[doc[row]]))
        for (d, item), starts in sorted(hits.items()):
            if best := self._verified(item, sorted(starts), texts[d]):
                out[d].append(best)
        return out

    def _windows(self, words: np.ndarray, opens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, length, first word) of the windows that a piece calls for."""
        rows = [np.zeros((0, 3), "i8")]
        for q, pieces in self.pieces.items():
            at, n, offset = pieces.find(_grams(words, q))
            e = n // 5
            width = 2 * e + 1
            turn = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            start = np.repeat(at - offset - e, width) + turn
            doc, n = np.repeat(np.searchsorted(opens, at, "right") - 1, width), np.repeat(n, width)
            fits = (start > opens[doc] - n) & (start < opens[doc] + lengths[doc])
            rows.append(np.stack([doc[fits], n[fits], start[fits]], axis=1))
        return tuple(np.unique(np.concatenate(rows), axis=0).T)

    def _verified(self, item: int, starts: list[int], words: np.ndarray) -> tuple[int, int, int] | None:
        """The best stretch around the windows, if it is within the edits allowed."""
        item_id, h = self.items[item]
        n, e, best, run = len(h), edits_allowed(len(h)), None, starts[:1]
        for s in [*starts[1:], None]:
            if s is not None and s <= run[-1] + n and s - run[0] <= 4 * n:
                run.append(s)
                continue
            low, high = max(0, run[0] - e), run[-1] + n + e
            edits, end = best_match(h, words[low:high])
            if edits <= e and (best is None or edits < best[1]):
                best = (item_id, edits, max(low, low + end - n))
            run = [s]
        return best


def _blocks(items: DataFrame, most: int, size: int = 1 << 23) -> Iterator[list[tuple[int, str]]]:
    """The items, the stated query set, in blocks of at most `most` items and about `size` characters; every document is
    held against each block. They come to the driver a partition at a time."""
    block, held = [], 0
    for i, t in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((i, t))
        held += len(t or "")
        if len(block) >= most or held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def _found(known: Items, texts: list[str | None], together: int = 1 << 19) -> Iterator[list[tuple[int, int, int]]]:
    """What Items.find has of each text, many texts at a time."""
    words, some, size = Words(), [], 0
    for k, t in enumerate(texts):
        some.append(words.hashes(t or ""))
        size += len(some[-1]) + known.longest
        if 8 * size > together or k == len(texts) - 1:
            yield from known.find(some)
            some, size = [], 0


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 8000) -> DataFrame:
    """(doc_id, item_id, edits, start) of every item that a document holds within a fifth of its words as edits; start
    is the word at which the stretch's window begins.

    Words are runs of letters and digits, lower-cased. Null and empty texts and items without words match nothing; null
    ids pass through; rows that repeat give their matches again; other columns are ignored."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("i"), whole_text(text_col).alias("t"))
    schema = "doc_id long, item_id long, edits int, start long"
    for some in _blocks(items, block):
        shared = spark.sparkContext.broadcast(some)  # bounded, see _blocks

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _items(shared)
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    ids, texts = (batch.column(c).slice(lo, 512).to_pylist() for c in range(2))
                    if out := [(i, *x) for i, xs in zip(ids, _found(known, texts), strict=True) for x in xs]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "start"])

        part = rows.mapInArrow(look, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", block: int = 8000) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no item is found (see leaks)."""
    at, out = docs.columns.index(text_col), docs
    for some in _blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _items(shared)
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    rows = batch.slice(lo, 512)
                    yield rows.filter(pa.array([not x for x in _found(known, rows.column(at).to_pylist())], pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out


_READY: dict[int, Items] = {}


def _items(shared) -> Items:
    """One copy in each Python worker."""
    key = hash(tuple(shared.value))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Items(shared.value)
    return _READY[key]
